from fleetlake.llm.line_dedup import dedup_lines, line_key

LONG = "a line that is long enough to count"


def run(docs):
    return {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in dedup_lines(docs).collect()}


def test_shared_lines_stay_in_the_largest_id_only(make_docs):
    got = run(make_docs({1: f"one\n{LONG}", 2: f"  {LONG.upper()} \t\ntwo\n{LONG}", 3: f"{LONG}\n{LONG}\nthree", 4: "short\nshort"}))
    assert got == {1: (2, 1, "one"), 2: (3, 2, "two"), 3: (3, 0, f"{LONG}\n{LONG}\nthree"), 4: (2, 0, "short\nshort")}


def test_two_documents_are_not_enough_and_repeats_in_one_do_not_count(make_docs):
    docs = {1: f"{LONG}\n{LONG}\n{LONG}", 2: LONG}
    assert run(make_docs(docs)) == {1: (3, 0, docs[1]), 2: (1, 0, LONG)}


def test_nulls_empties_and_repeated_rows(make_docs):
    got = sorted(map(tuple, dedup_lines(make_docs([(1, None), (2, ""), (3, LONG), (3, LONG), (4, LONG), (None, LONG)])).collect()), key=str)
    assert got == sorted([(1, 1, 0, ""), (2, 1, 0, ""), (3, 1, 1, ""), (3, 1, 1, ""), (4, 1, 0, LONG), (None, 1, 1, "")], key=str)


def test_length_is_in_code_points_and_case_is_ascii(make_docs):
    assert line_key("\x0b ÉA \x85") == "Éa \x85"
    nineteen, twenty = "é" * 19, "é" * 20
    docs = {i: f"{nineteen}\n{twenty}" for i in range(3)}
    assert run(make_docs(docs)) == {0: (2, 1, nineteen), 1: (2, 1, nineteen), 2: (2, 0, docs[2])}
    upper = {i: ("É" if i else "é") + "x" * 30 for i in range(3)}
    assert all(n == 0 for _, n, _ in run(make_docs(upper)).values())


def test_empty_table_and_clashing_columns(spark, make_docs):
    assert dedup_lines(make_docs([])).collect() == []
    docs = make_docs({i: LONG for i in range(4)}).selectExpr("*", "doc_id AS keeper", "text AS h1", "lang AS drops", "lang AS n")
    assert {k: v[1] for k, v in run(docs).items()} == {0: 1, 1: 1, 2: 1, 3: 0}
