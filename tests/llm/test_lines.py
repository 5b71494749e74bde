from linkloom.llm import lines
from oracle import duck, rows


def test_sql(spark, sf):
    assert rows(lines.op7_site_spread_lines(spark, sf).toPandas()) == rows(duck(sf, lines.OP7_SQL))


def test_threshold_is_exact(spark, make):
    docs = []
    for k in range(1, 12):  # line k lies on k sites, twice on one of them
        docs += [(100 * k + s, f"the shared line {k}\nown {k} {s} text", f"site{s}") for s in range(k)]
        docs.append((100 * k + 50, f" the shared line {k}\t\nown {k} again text", "site0"))
    got = {r.doc_id: r.text for r in lines.clean(make(docs)).collect()}
    for i, text, _ in docs:
        k = i // 100
        keeper = min(j for j, t, _ in docs if f"line {k}\n" in t.replace("\t", "") and j // 100 == k)
        want = text if k < 5 or i == keeper else text.split("\n")[1]
        assert got[i] == want


def test_many_sites(spark, make):
    """Estimates far above the threshold decide by themselves."""
    docs = [(i, "a line of boilerplate\nown " + str(i), f"s{i}") for i in range(400)]
    got = {r.doc_id: r.text for r in lines.clean(make(docs)).collect()}
    assert got[0].startswith("a line") and all(got[i] == f"own {i}" for i in range(1, 400))


def test_edges(spark, make):
    docs = [(1, None, "a"), (2, "", None), (None, "x y z", "a"), (3, "x y z\nx y z", "b"), (3, "x y z", "c"), (4, "x y z", None), (5, "x y z\n\n ok", "d"), (6, "x y z", "e"), (7, "x y z", "f"), (8, "hi\nhi", "a")]
    got = sorted(((r.doc_id, r.n_lines, r.n_removed, r.text) for r in lines.clean(make(docs)).collect()), key=repr)
    want = sorted([(1, 0, 0, None), (2, 1, 0, ""), (None, 1, 1, ""), (3, 2, 0, "x y z\nx y z"), (3, 1, 0, "x y z"), (4, 1, 1, ""), (5, 3, 1, "\n ok"), (6, 1, 1, ""), (7, 1, 1, ""), (8, 2, 0, "hi\nhi")], key=repr)
    assert got == want
    assert lines.clean(make([])).count() == 0
    out = lines.cleaned_documents(make(docs))
    assert out.columns == make(docs).columns
    kept = out.collect()
    assert sorted((r.doc_id for r in kept if r.doc_id is not None)) == [1, 2, 3, 3, 5, 8]
    assert all(r.text is None or r.n_chars == len(r.text) for r in kept)


def test_rows_without_ids(spark, make):
    """Rows that share an id, or have none, are cleaned each by its own text; a
    very long text is worked whole."""
    long = "\n".join(["a shared long line"] + [f"own line number {k} here" for k in range(40_000)])
    docs = [(None, f"a shared long line\nown {k}", f"s{k}") for k in range(6)] + [(7, "a shared long line\nx", "s1"), (7, "y\na shared long line", "s2"), (8, long, "s3")]
    got = sorted(((r.doc_id or -1, r.n_removed, r.text) for r in lines.clean(make(docs)).collect()))
    assert [g for g in got if g[0] == -1] == [(-1, 1, f"own {k}") for k in range(6)]
    assert [g for g in got if g[0] == 7] == [(7, 0, "a shared long line\nx"), (7, 0, "y\na shared long line")]
    assert got[-1] == (8, 1, long.partition("\n")[2])
