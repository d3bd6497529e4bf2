import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from orefield.llm.line_dedup import dedup_lines

SF = "/root/testdata/sf0.01"


def brute(rows: list[tuple[int, str]]) -> dict[int, str]:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            w = tuple(lines[p : p + 3])
            if any(x.strip() for x in w):
                if w in seen:
                    gone |= {p, p + 1, p + 2}
                seen.add(w)
        out[doc] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_whole_table_against_brute_force_and_sql(spark):
    from orefield.llm.queries import oracle_sql, queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in queries()["op9_line_windows"](spark, SF).collect()}
    wanted = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {k: r.text for k, r in got.items()} == wanted
    assert sum(r.n_removed > 0 for r in got.values()) > 5
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    cols = [c for c in oracle_sql()["op9_line_windows"] and con.sql(oracle_sql()["op9_line_windows"]).columns]
    assert {tuple(r) for r in con.sql(oracle_sql()["op9_line_windows"]).fetchall()} == {tuple(r[c] for c in cols) for r in got.values()}


def test_random_small_documents(spark):
    rng = random.Random(1)

    @settings(max_examples=12, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(["a", "b", "", " "]), min_size=1, max_size=9), min_size=1, max_size=6))
    def run(docs):
        rows = [(k, "\n".join(x)) for k, x in enumerate(docs)]
        rng.shuffle(rows)
        got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert {r.doc_id: r.text for r in got} == brute(rows)

    run()


def test_frames(spark):
    same = "x\ny\nz"
    rows = [(1, same, "p"), (1, same, "p"), (2, same, "q"), (None, same + "\nw", "r"), (3, None, "s"), (4, "", "t"), (5, "x\ny", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")  # a clashing name
    got = sorted(((r.doc_id or 99, r.text, r.row, r.n_lines, r.n_removed) for r in dedup_lines(df).collect()), key=str)
    assert got == sorted([(1, same, "p", 3, 0), (1, same, "p", 3, 0), (2, "", "q", 3, 3), (99, "w", "r", 4, 3), (3, None, "s", 0, 0), (4, "", "t", 1, 0), (5, "x\ny", "u", 2, 0)], key=str)
    assert dedup_lines(df.limit(0)).count() == 0
    assert dedup_lines(df).columns == ["doc_id", "text", "row", "n_lines", "n_removed"]


def test_very_long_texts(spark):
    """A text of many windows, most of which another has too, some in an order of its own."""
    rng = random.Random(3)
    long = [f"line {rng.randrange(30_000)}" for _ in range(40_000)]
    rows = [(1, "\n".join(long)), (2, "\n".join(long[:20_000] + ["a line of its own"] + long[20_000:])), (3, "\n".join(reversed(long))), (4, "x" * 2_000_000)]
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
