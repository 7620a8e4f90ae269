"""Near duplicates, repeated lines, decontamination and components beside brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from basketmatch.llm import decontaminate, line_dedup, near_dedup
from basketmatch.llm.components import components
from basketmatch.llm.scratch import stored
from tests.llm.odd_rows import ODD

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "so", "ti") for b in ("ba", "de", "fi", "go", "hu", "xo")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, text, times):
    words = text.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = "zz" + rng.choice(WORDS)
    return " ".join(words)


def word_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows):
    """Smallest reachable id, by all pairs."""
    sets = [(d, word_set(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {d: find(d) for d in root}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_equal_all_pairs(spark, make, seed):
    rng = random.Random(seed)
    rows = list(ODD)
    for g in range(12):
        base = prose(rng, rng.choice([4, 5, 8, 60, 200]))
        chain = base
        for i in range(rng.choice([1, 3, 9])):
            rows.append((1000 * (g + 1) + 7 * i, rng.choice([base, base.upper(), chain])))
            chain = changed(rng, chain, rng.choice([1, 2, 3]))
    out = near_dedup.near_duplicates(make(rows)).collect()
    want = groups(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id)
    sizes = {(d, len(word_set(t))) for d, t in rows}
    assert {(r.doc_id, r.n_shingles) for r in out} == sizes


def test_bucket_with_several_components(spark):
    """Classes that share a band with the hub but are no link to it still find each other."""
    rng = random.Random(5)
    head, rows = prose(rng, 60), []
    for i in range(6):
        tail = prose(rng, 40)
        rows += [(10 * i, f"{head} {tail}"), (10 * i + 1, f"{head} {changed(rng, tail, 2)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == groups(rows)


def test_near_duplicates_of_no_rows(spark, make):
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_sketch_bits_follow_similarity():
    assert near_dedup.most_differing_bits(100) == 0
    assert near_dedup.most_differing_bits(55) > near_dedup.most_differing_bits(75) > 0


def test_components_of_a_path_a_star_and_a_cycle(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(500, i) for i in range(501, 540)] + [(500, 500)]
    cycle = [(900, 901), (901, 902), (902, 900), (None, 3)]
    df = spark.createDataFrame(path + star + cycle, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {i: 500 for i in range(500, 540)} | {i: 900 for i in range(900, 903)}
    assert components(df.limit(0)).count() == 0


# Lines.


def brute_lines(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?] )", text) if x] if text else []


def test_lines_lose_nothing(spark):
    texts = ["a. b! c? d\ne", "", "\n\n", "no end", "A!! B!! C. \x01 ", "x.y z. ", "\0", "a. \0b! \0\n\0", ". ! ? \n"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", line_dedup.lines(F.col("text")).alias("ls"))
    for r in df.collect():
        assert "".join(r.ls) == r.text and r.ls == brute_lines(r.text)


def sentences(rng, n):
    return [prose(rng, rng.randint(5, 12)).capitalize() + "." for _ in range(n)]


def test_later_runs_go_and_the_rest_stays(spark, make):
    rng = random.Random(3)
    passage = " ".join(sentences(rng, 7))
    own = [" ".join(sentences(rng, 4)) for _ in range(6)]
    rows = [
        (10, f"{own[0]}\n{passage}\n{own[1]}"),
        (11, f"{own[2]}\n{passage.upper()}\n{own[3]}"),  # case does not matter
        (12, f"{own[4]} {passage} {own[5]}"),  # inside a longer line
        (13, passage),
        (14, "Short line. Other."),
        (15, "Short line. Other."),  # too few words for a run
        (16, "\n".join(["Again and again, the same."] * 40)),
    ]
    out = {(r.doc_id, i): r for i, r in enumerate(line_dedup.dedup_lines(make(rows + ODD)).orderBy("doc_id").collect())}
    by_id = {d: r for (d, _), r in out.items()}
    assert len(out) == len(rows) + len(ODD)
    assert by_id[10].text == rows[0][1] and by_id[10].removed == []
    assert by_id[11].text.split() == f"{own[2]} {own[3]}".split()
    assert by_id[12].text.split() == f"{own[4]} {own[5]}".split()
    assert by_id[13].text == ""
    assert by_id[14].text == by_id[15].text == "Short line. Other."
    assert by_id[16].text.strip() == "Again and again, the same."
    assert by_id[1].text is None and by_id[2].text == ""
    for d, text in ODD:
        if d in (3, 4, 6, 7, 8):
            assert by_id[d].text == text
    assert by_id[5].text == ODD[6][1]  # rows that repeat id and text are one document


def test_every_run_of_three_lines_is_found(spark, make):
    rng = random.Random(9)
    rows, runs = [], []
    for i in range(30):
        run = sentences(rng, rng.randint(3, 6))
        runs.append(run)
        rows.append((i, " ".join(sentences(rng, 3) + run + sentences(rng, 3))))
        rows.append((100 + i, " ".join(sentences(rng, 2) + run + sentences(rng, 2))))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    for i, run in enumerate(runs):
        assert all(s in got[i] for s in run)
        if sum(len(s.split()) for s in run) >= line_dedup.MIN_WORDS:
            assert not any(s in got[100 + i] for s in run)
        assert len(got[100 + i].split()) >= 20
    assert line_dedup.dedup_lines(make([])).count() == 0


def repeated_lines(rows):
    """Per row the lines in a run of MIN_WORDS words that an earlier place holds, by all pairs of places."""
    texts = [[x.strip(" \t\r\n").lower() for x in brute_lines(t)] for _, t in rows]
    out = []
    for d, ls in enumerate(texts):
        gone = set()
        for e, other in enumerate(texts[: d + 1]):
            for by in range(1 - len(other), len(ls)):
                if e == d and by <= 0:
                    continue
                run = []
                for i in range(len(ls) + 1):
                    if i < len(ls) and 0 <= i - by < len(other) and ls[i] == other[i - by]:
                        run.append(i)
                    else:
                        gone |= set(run) if sum(len(ls[k].split(" ")) for k in run) >= line_dedup.MIN_WORDS else set()
                        run = []
        out.append(gone)
    return out


def test_passages_of_one_and_of_two_lines_between_different_neighbours(spark, make):
    rng = random.Random(12)
    line = lambda n: prose(rng, n).capitalize() + "."
    rows, passages = [], []
    for i, sizes in enumerate([[60], [30, 30], [25], [12, 9], [3, 40]] * 8):
        passages.append(" ".join(line(n) for n in sizes))
        for copy in (0, 1):
            rows.append((1000 * copy + i, f"{line(9)} {line(8)} {passages[-1]} {line(7)} {line(11)}"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    for i, passage in enumerate(passages):
        assert passage in got[i] and got[i] == rows[2 * i][1]
        assert passage not in got[1000 + i] and len(got[1000 + i].split()) == 35


def test_removed_lines_equal_all_pairs_of_places(spark, make):
    rng = random.Random(13)
    pool = [prose(rng, rng.choice([1, 2, 4, 7, 9, 12, 19, 20, 30])).capitalize() + "." for _ in range(14)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(make(rows)).collect()}
    for (d, text), gone in zip(rows, repeated_lines(rows)):
        assert {i for s, e in out[d].removed for i in range(s, e + 1)} == gone, d
        assert out[d].text == "".join(x for i, x in enumerate(brute_lines(text)) if i not in gone)
    assert any(r.removed for r in out.values()) and any(r.text for r in out.values())


def test_minima_of_all_windows_come_from_one_compiled_loop(spark, make):
    rng = random.Random(16)
    sizes = [[1] * 50, [1, 19, 20, 21, 1], [19, 1, 1, 1, 19, 2, 30], [20], [19], [4, 5, 6]]
    sizes += [[rng.choice([1, 1, 2, 3, 9, 15, 40]) for _ in range(rng.randint(1, 60))] for _ in range(20)]
    rows = [(i, " ".join(prose(rng, n) + "." for n in ns)) for i, ns in enumerate(sizes)]
    listed = stored(line_dedup._listed(make(rows)), "lines")
    found = line_dedup._minima(listed)
    got = {(r.doc_id, r.at) for r in found.collect()}
    want = set()
    for r in listed.collect():
        for a in range(len(r.n)):
            for b in range(a, len(r.n)):
                words = sum(r.n[a : b + 1])
                if words >= line_dedup.MIN_WORDS > max(words - r.n[a], words - r.n[b]):
                    want.add((r.doc_id, min(range(a, b + 1), key=lambda k: (r.h[k], -k))))
    assert got == want and len(want) > 100
    # Apart, or too large to be compiled, each row would carry the arrays of its text.
    plan = found._jdf.queryExecution().executedPlan()
    assert not re.search(r"- (Generate|Filter) ", plan.toString())
    loops = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(plan)
    assert all(loops.apply(i)._3().maxMethodCodeSize() < 8000 for i in range(loops.size()))


def test_frequent_lines_beside_a_rare_one_do_not_hide_it(spark, make):
    rng = random.Random(15)
    line = lambda n: prose(rng, n).capitalize() + "."
    rows, rare = [], []
    for i in range(20):
        heads = f"{line(3)} {line(4)}"
        rare.append(line(40))
        rows += [(i, f"{line(8)} {heads} {line(9)}"), (100 + i, f"{line(7)} {heads} {rare[i]} {line(6)}")]
        rows.append((200 + i, f"{heads} {line(5)} {heads} {rare[i]} {line(8)}"))
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(make(rows)).collect()}
    for i in range(20):
        assert rare[i] in got[100 + i] and rare[i] not in got[200 + i] and len(got[200 + i].split()) == 20


def test_blank_lines_go_with_the_line_before(spark, make):
    rng = random.Random(14)
    p = [prose(rng, 15) for _ in range(4)]
    rows = [(1, f"\n{p[0]}\n\n{p[1]}\n\n{p[2]}\n"), (2, f"\n\n{p[0]}\n{p[1]}\n\n\n"), (3, f"{p[3]}\n\n{p[0]}\n{p[1]}\n\nOwn.\n")]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(make(rows)).collect()}
    assert [got[d].text for d in (1, 2, 3)] == [rows[0][1], "", f"{p[3]}\n\nOwn.\n"]
    assert [(r.s, r.e) for r in got[3].removed] == [(2, 4)]


# Benchmark items.


def letters(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def item_set(text, k=5):
    """Runs of k words; an item of fewer words is one run."""
    w = letters(text)
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def run_length(item):
    return min(5, len(letters(item)))


def test_contaminated_equals_exact_containment(spark, make):
    rng = random.Random(4)
    items = [(i, prose(rng, n)) for i, n in enumerate([3, 5, 12, 30, 45, 80, 300, 400])] + [(80, "Zulu"), (81, "yes, Zulu no")] + [(90, None), (91, ""), (None, "null id")]
    rows = list(ODD)
    for i, text in items[:8]:
        rows.append((100 + i, f"{prose(rng, 500)} {text.upper()}, {prose(rng, 3000)}"))
        rows.append((200 + i, f"{prose(rng, 50)} {changed(rng, text, max(1, len(text.split()) // 60))} {prose(rng, 50)}"))
        rows.append((300 + i, f"{prose(rng, 50)} {' '.join(text.split()[: len(text.split()) // 2])}"))
    rows += [(400, items[0][1] + "!"), (401, prose(rng, 5000)), (402, "so Yes Zulu; no end"), (403, "yes no zulu")]
    bench = spark.createDataFrame([(*r, "x", "y") for r in items], "item_id long, text string, doc_id string, h string")
    got = {(r.doc_id, r.item_id): (r.n_found, r.n_shingles) for r in decontaminate.contaminated(make(rows), bench).collect()}
    want = {}
    for d, t in rows:
        for i, q in items:
            common = len(item_set(q) & item_set(t, run_length(q))) if letters(q) else 0
            if d is not None and i is not None and letters(q) and 100 * common >= 75 * len(item_set(q)):
                want[d, i] = (common, len(item_set(q)))
    assert got == want and {(400, 0), (107, 7), (100, 0), (402, 80), (402, 81), (403, 80)} <= set(want) and (403, 81) not in want
    kept = {r.doc_id for r in decontaminate.without_contaminated(make(rows), bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}
    assert decontaminate.contaminated(make([]), bench).count() == 0
    assert decontaminate.contaminated(make(rows), bench.limit(0)).count() == 0
