"""Run the local oracle compare for all (or named) registered queries."""
import sys, time, os
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import __spark_entry__ as E
from pathsift.session import build_session
from tests.oracle_compare import compare, duck

sf = os.environ.get("SF", "/root/testdata/sf0.01")
names = sys.argv[1:]
spark = build_session("local[8]")
qs, sq = E.queries(), E.oracle_sql()
con = duck(sf)
bad = []
for n in (names or sorted(qs)):
    t = time.time()
    if n not in sq:
        df = qs[n](spark, sf); c = df.count()
        print(f"{n:32s} rows-only {c:8d} {time.time()-t:6.1f}s", flush=True); continue
    try:
        ok, c = compare(spark, n, qs[n], sq[n], sf, con)
    except Exception as e:
        ok, c = False, -1; print(n, "ERROR", repr(e)[:2000])
    if not ok: bad.append(n)
    print(f"{n:32s} {'OK ' if ok else 'BAD'} {c:8d} {time.time()-t:6.1f}s", flush=True)
print("BAD:", bad)
