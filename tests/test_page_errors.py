"""Pages whose markup stops the parser."""

import pytest

from pathsift.functions import html_tree
from pathsift.operators import dom, extract


@pytest.mark.parametrize("bad", ["<![foo]>", "<![ ]>", "<![%x[ a ]]>"])
def test_bad_declaration_is_a_comment(bad):
    nodes = html_tree.page_records(f"<body><div>a</div>{bad}<div>b</div></body>")[2]
    assert [n.text for *_, n in nodes if n.tag == "div"] == ["a", "b"]


def test_page_that_stops_the_parser_is_rejected(spark):
    broken = "<body><p>a</p>&#" + "9" * 5000 + ";<p>b</p></body>"
    rows = [(1, "a", "<body><p>a</p></body>"), (2, "a", broken), (3, "b", "<body></body>"), (4, "a", "<body></body>")]
    pages = spark.createDataFrame(rows, "page_id long, domain string, html string")
    assert {r.page_id for r in dom.explode_nodes(pages).collect()} == {1, 3, 4}
    main = spark.createDataFrame([(1, "a")], "page_id long, domain string")
    model = spark.createDataFrame([("a", 1)], "domain string, seq int")
    got = {r.page_id: r.reason for r in extract.page_outcomes(pages, main, model).collect()}
    assert got == {1: None, 2: "parse_error", 3: "no_model", 4: "no_text"}
