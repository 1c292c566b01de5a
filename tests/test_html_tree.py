from pathsift.functions import html_tree as h


def _nodes(html):
    return {a: n for a, _t, _p, _c, _b, n in h.page_records(html)[2]}


def test_text_modes_fixture_case():
    n = _nodes("<!DOCTYPE html><html><body><div>own<p>a</p>tail<section><p>b</p></section></div></body></html>")
    div = n["/html/body/div"]
    assert h.direct_text(div) == "atail"
    assert h.child_text(div) == "a"
    assert h.subtree_text(div) == "ownatailb"


def test_sibling_paths_get_indexes():
    n = _nodes("<html><body><div>x</div><div><p>y</p></div></body></html>")
    assert "/html/body/div[1]" in n and "/html/body/div[2]" in n


def test_p_start_closes_open_p_and_inline():
    n = _nodes("<html><body><article><h1>T</h1><p><b>A<br><p>B</p></article></body></html>")
    assert h.direct_text(n["/html/body/article"]) == "T A B"


def test_script_raw_text_and_entities():
    t, dt, nodes = h.page_records('<!DOCTYPE html><html><head><title>a &amp; b</title>'
                                  '<script>var t="</p>";</script></head><body><nav><ul><li>x</li><li>y</li>'
                                  '</ul></nav></body></html>')
    assert t == "a & b" and dt == "html"
    assert h.direct_text({a: n for a, *_r, n in nodes}["/html/body/nav"]) == "xy"


def test_doctypes():
    assert h.page_records("<!DOCTYPE html><html></html>")[1] == "html"
    x = h.page_records('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Strict//EN" "x"><html></html>')[1]
    assert x.startswith("html PUBLIC")
    assert h.page_records("<html></html>")[1] is None


def test_empty_sentinel():
    n = _nodes("<html><body><footer>bare text</footer></body></html>")
    assert h.direct_text(n["/html/body/footer"]) == "empty"
