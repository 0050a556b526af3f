import hashlib
import random

import pytest

import fleetlake.llm.source_mixing as m
from fleetlake.llm.source_mixing import Mix, mixed, mixed_documents, mixing_plan, realised

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split(budget, nodes):
    """{name: share} by filling siblings one after the other: the definition. nodes: {name: (weight, room)}."""
    left, out, todo = min(budget, sum(r for _, r in nodes.values())), {}, dict(nodes)
    while todo:
        total = sum(w for w, _ in todo.values())
        name = min(todo, key=lambda n: (todo[n][1] / todo[n][0], n))
        weight, room = todo[name]
        if room * total > weight * left:
            reached = 0
            for n in sorted(todo, key=lambda n: (todo[n][1] / todo[n][0], n)):
                w = todo[n][0]
                out[n] = left * (reached + w) // total - left * reached // total
                reached += w
            return out
        out[name] = room
        left -= room
        del todo[name]
    return out


def brute(rows, mix):
    """{(doc_id, domain, lang, source): (copies, cut_tokens)} by reading epochs document by document."""
    def domain(source):
        digits = source[len(source.rstrip("0123456789")):] if source else ""
        return f"domain{int(digits) % 4}" if digits else "other"

    leaves = {}
    for i, text, lang, source, _ in rows:
        leaves.setdefault((domain(source), lang, source), []).append((i, len((text or "").split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    room = lambda prefix: sum(n * mix.max_epochs for k, n in tokens.items() if k[:len(prefix)] == prefix)
    budget = {(): sum(tokens.values()) * mix.percent_of_tokens // 100}
    for depth, weights in enumerate((mix.domains, mix.languages, mix.sources)):
        for parent in [k for k in budget if len(k) == depth]:
            names = {k[depth] for k in leaves if k[:depth] == parent}
            shares = split(budget[parent], {n: (weights.get(n, mix.other), room((*parent, n))) for n in names})
            budget.update({(*parent, n): s for n, s in shares.items()})
    out = {}
    for leaf, docs in leaves.items():
        total = tokens[leaf]
        epochs, rest = (budget[leaf] // total, budget[leaf] % total) if total else (0, 0)
        md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
        text = {i: t or "" for i, t, *_ in rows}
        for i, n in sorted(docs, key=lambda d: md5(f"{mix.seed}:{epochs}:{d[0]}:{md5(text[d[0]])}")):
            copies, cut = epochs + (n <= rest), max(rest, 0) if n > rest else 0
            rest = rest - n if n <= rest else -1
            if copies or cut:
                out[i, *leaf] = copies, cut
    return out


def random_docs(seed, n=400):
    rng = random.Random(seed)
    return [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40, 200])), rng.choice(["en"] * 6 + ["de", "fr", "xx"]),
             f"src{min(rng.randrange(40), rng.randrange(12))}" if rng.random() < 0.9 else "web", 0) for i in range(n)]


@pytest.mark.parametrize("mix, range_docs", [
    (Mix(), 7), (Mix(percent_of_tokens=30, max_epochs=1), 10_000), (Mix(percent_of_tokens=250), 7),
    (Mix(domains={"domain3": 500}, sources={"src3": 9, "src7": 2}, seed=9), 7)])
def test_shares_and_prefixes_against_brute_force(spark, monkeypatch, mix, range_docs):
    monkeypatch.setattr(m, "RANGE_DOCS", range_docs)
    rows = random_docs(mix.percent_of_tokens)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.domain, r.lang, r.source): (r.copies, r.cut_tokens) for r in mixed(docs, mix).collect()}
    assert got == brute(rows, mix)
    n_tokens = [len((t or "").split()) for _, t, *_ in rows]
    total = min(sum(n_tokens) * mix.percent_of_tokens // 100, sum(n_tokens) * mix.max_epochs)
    assert sum(n_tokens[i] * copies + cut for (i, *_), (copies, cut) in got.items()) == total  # to the token
    shares = realised(docs, mix).collect()
    assert all(r.share == r.taken for r in shares) and sum(r.taken for r in shares) == total
    texts = mixed_documents(docs, mix).collect()
    assert sum(len((r.text or "").split()) for r in texts) == total


def test_a_cut_text_keeps_its_white_space(spark):
    rows = [(1, " \n a\tb  c\u00a0c \n\n d  ", "en", "src1", 20)]
    for percent, text in ((25, " \n a"), (50, " \n a\tb"), (75, " \n a\tb  c\u00a0c"), (100, rows[0][1]), (125, " \n a")):
        out = mixed_documents(spark.createDataFrame(rows, SCHEMA), Mix(percent_of_tokens=percent)).collect()
        assert out[0].text == text and out[0].n_chars == (20 if percent == 100 else len(text))
        assert [r.text for r in out[1:]] == ([rows[0][1]] if percent > 100 else [])


def test_identical_rows_share_the_end_of_a_prefix_and_budgets_do_not_overflow(spark):
    rows = [(1, "a b c d", "en", "src1", 7)] * 3 + [(1, "x y", "en", "src1", 3)]
    taken = mixed(spark.createDataFrame(rows, SCHEMA), Mix(percent_of_tokens=60)).collect()
    assert 8 - 2 <= sum(r.tokens * r.copies + r.cut_tokens for r in taken) <= 8
    assert len({(r.copies, r.cut_tokens) for r in taken if r.tokens == 4}) == 1
    big = spark.range(2000).selectExpr(
        "'domain0' AS domain", "'en' AS lang", "concat('s', id) AS source", "100000000000 + id AS tokens", "1L AS n_docs")
    shares = m.budgets(big, Mix(sources={f"s{i}": 10 ** 6 + i for i in range(50)})).agg({"share": "sum", "tokens": "sum"}).first()
    assert shares["sum(share)"] == shares["sum(tokens)"]


def test_shortage_goes_to_siblings_before_other_branches(spark):
    rows = [(0, "w " * 10, "en", "a0", 0), (1, "w " * 1000, "en", "b0", 0), (2, "w " * 1000, "de", "c0", 0)]
    mix = Mix(domains={}, languages={}, percent_of_tokens=40, max_epochs=2)
    plan = {r.source: r.share for r in mixing_plan(spark.createDataFrame(rows, SCHEMA), mix).collect()}
    assert plan == {"a0": 20, "b0": 382, "c0": 402}  # 804 in all


def test_nulls_empties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "src1", 0), (3, "a b", "en", "src1", 0), (3, "a b", "en", "src1", 0), (None, "a b c", None, "src2", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    taken = mixed(docs).collect()
    assert all(r.copies <= 4 for r in taken) and {r.doc_id for r in taken} <= {1, 2, 3, None}
    assert len({r.copies for r in taken if r.doc_id == 3}) <= 1
    wide = docs.selectExpr("*", "lang AS domain", "lang AS row", "doc_id AS copies", "doc_id AS epochs", "doc_id AS leaf_lang")
    out = mixed_documents(wide)
    assert out.columns == wide.columns and out.count() == sum(r.copies + (r.cut_tokens > 0) for r in taken)
    assert mixed(docs.limit(0)).collect() == []
    assert mixed_documents(docs.limit(0)).collect() == []
