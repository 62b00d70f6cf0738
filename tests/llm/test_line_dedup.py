"""Lines removed against a dictionary of sites per line."""
from fleetweave.llm import line_dedup


def brute(rows, least):
    """Definition over (id, text, site) rows; the order of equal ids by text digest does not matter in these rows."""
    sites, first = {}, {}
    for i, text, site in rows:
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            plain = line.strip(" ")
            if plain:
                sites.setdefault(plain, set()).update({site} - {None})
                place = (i is None, i or 0, k)
                first[plain] = min(first.get(plain, place), place)
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [s for k, s in enumerate(lines)
                if not s.strip(" ") or len(sites[s.strip(" ")]) < least or first[s.strip(" ")] == (i is None, i or 0, k)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, str(row[1]))


def same(df, least):
    rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
    found = line_dedup.without_boilerplate(df, min_sites=least)
    assert [c for c in found.columns if c not in ("n_lines", "n_removed")] == [c for c in df.columns if c not in ("n_lines", "n_removed")]
    ours = [(r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in found.collect()]
    assert sorted(ours, key=key) == sorted(brute(rows, least), key=key)


def test_boilerplate_over_sites(spark):
    rows = [(i, f"head {i}\n menu \n\nmenu\nbody {i % 7}\nrare {i % 30}\n" + "tail", f"s{i % 12}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s1"), (102, "menu", None), (None, "menu\nfoot", "s2"), (103, "\n\n", "s3"),
             (104, "menu\n" * 3000 + "own line", "s4"), (5, rows[5][1], "s5"), (5, rows[5][1], "s5")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, n_lines int, sketch int")
    for least in (2, 5, 6, 7, 12, 13):
        same(df, least)


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert line_dedup.without_boilerplate(df).collect() == []


def test_many_sites_are_counted_exactly_near_the_threshold(spark):
    """Estimates err at thousands of sites; around the threshold the exact count decides."""
    counts = {f"line {n}": n for n in (1990, 1999, 2000, 2001, 2010, 2500)}
    rows = [(k * 10000 + s, line, f"site {s}") for k, (line, n) in enumerate(counts.items()) for s in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = line_dedup.without_boilerplate(df, min_sites=2000).where("n_removed > 0")
    found = found.selectExpr("cast(doc_id / 10000 as int) as k").groupBy("k").count()
    assert {tuple(r) for r in found.collect()} == {(2, 1999), (3, 2000), (4, 2009), (5, 2499)}


def test_the_query_against_sql(spark):
    from compare import connect, differences
    from fleetweave.llm.queries import ORACLES, QUERIES

    path = "/root/testdata/sf0.001"
    assert differences(spark, connect(path), path, "op2", QUERIES["op2_line_dedup"], ORACLES["op2_line_dedup"]) == []
