"""Repeated runs of lines across documents, by winnowing over line hashes.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from basketmatch.llm.scratch import stored

#: Words of a run that is deleted.
MIN_WORDS = 20

_KEY = ["doc_id", "th"]
_CUT = "\0"


def lines(text: Column) -> Column:
    """The text cut after each newline, and after ``. ! ?`` and a blank; nothing is lost."""
    marked = text
    for end in ["\n", ". ", "! ", "? "]:
        marked = F.replace(marked, F.lit(end), F.lit(end + _CUT))
    # A split at one plain character needs no regular expression; a text that holds it does.
    parts = F.when(F.contains(text, F.lit(_CUT)), F.split(text, r"(?<=\n|[.!?] )")).otherwise(F.split(marked, _CUT))
    return F.array_remove(parts, "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\n"))


def _words(bare: Column) -> Column:
    blanks = F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(" "), F.lit("")))
    return F.when(bare == "", 0).otherwise(blanks + 1)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _listed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, h, n, cut): per text the hashes and words of its lines that are not blank.

    Line ``k`` of these and the blank ones after it are the lines cut[k] to
    cut[k + 1] - 1 of the text.
    """
    some = docs.where(F.btrim("text", F.lit(" \t\r\n")) != "")
    texts = some.select("doc_id", F.xxhash64("text").alias("th"), F.transform(lines(F.col("text")), _bare).alias("ls"))

    def line(bare: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(F.lower(bare)).alias("h"), _words(bare).alias("n"), i.alias("i"))

    full = texts.select(*_KEY, F.size("ls").alias("size"), F.filter(F.transform("ls", line), lambda x: x["n"] > 0).alias("full"))
    idx = F.col("full.i")
    cut = F.concat(F.array(F.lit(0)), F.slice(idx, 2, F.size(idx)), F.array("size"))
    return full.select(*_KEY, F.col("full.h").alias("h"), F.col("full.n").alias("n"), cut.alias("cut"))


def _by_word(listed: DataFrame, *arrays: str) -> DataFrame:
    """A row for each word, at place ``p`` of the text, beside the arrays of its text.

    A word is line * 1024 + its place in the line * 32 + words of the line, which is
    cut to MIN_WORDS words; ``own`` has those of the text. So the line that holds the
    20th word from here is found without counting. What follows has plain columns
    only: Spark compiles it with the explode into one loop, in which no row is made
    that would hold these arrays.
    """
    def words(n: Column, i: Column) -> Column:
        first, n = i.cast("bigint") * 1024, F.least(n, F.lit(MIN_WORDS))
        return F.sequence(first + n, first + n * 33 - 32, F.lit(32).cast("bigint"))

    own = listed.select(*_KEY, "h", *arrays, F.flatten(F.transform("n", words)).alias("own"))
    # The outer form, as the plain one has the array made once more to leave out empty ones.
    return own.select(*_KEY, "h", *arrays, "own", F.posexplode_outer("own").alias("p", "w"))


def _line(w: Column) -> Column:
    return F.shiftright(w, 10).cast("int")


def _before(w: Column) -> Column:
    """Words before this one in its line."""
    return F.shiftright(w, 5).bitwiseAND(31).cast("int")


def _after(w: Column) -> Column:
    """Words after this one in its line."""
    return w.bitwiseAND(31).cast("int") - 1 - _before(w)


def _word(p: Column) -> Column:
    return F.get("own", p)


def _lines_of(first: Column, size: Column) -> Column:
    return F.slice("h", first + 1, size)


def _lowest(first: Column, run: Column) -> Column:
    """Place of the smallest line hash of the lines ``run``, which begin at ``first``; the rightmost of equal ones."""
    return first + F.size(run) - F.array_position(F.reverse(run), F.array_min(run)).cast("int")


def _minima(listed: DataFrame) -> DataFrame:
    """(doc_id, th, at, mark): the place of the smallest line hash of each window, and that hash.

    The windows are the shortest runs of MIN_WORDS words, from both of their ends. One
    that selects the same place as the window from the line before is left out.
    """
    p, reach = F.col("p"), MIN_WORDS - 1
    rows = _by_word(listed).where(_before(F.col("w")) == 0)
    rows = rows.select(*_KEY, "h", "own", "p", _line(F.col("w")).alias("first"), _word(p + reach).alias("end"), _word(p - 1).alias("prior"))
    # The run from the line before, and the shortest one to the end of this one.
    longer = _line(_word(p - 1 - _before(F.col("prior")) + reach))
    begin = _line(_word(p + _after(F.col("end"))))
    rows = rows.select(*_KEY, "h", "first", _line(F.col("end")).alias("last"), begin.alias("begin"), longer.alias("longer"))
    first, last, longer = F.col("first"), F.col("last"), F.col("longer")
    runs = F.array(_lines_of(first, last - first + 1))
    rows = rows.where("begin <=> first").select(*_KEY, "h", "first", "last", "longer", F.explode(runs).alias("run"))
    rows = rows.select(*_KEY, "h", "first", "last", "longer", _lowest(first, F.col("run")).alias("at"))
    # If both end at the same line, the longer one is no window.
    at, hash_at = F.col("at"), F.get("h", F.col("at"))
    again = (longer < last) & (at <= longer) & (hash_at <= F.get("h", first - 1))
    return rows.where(~F.coalesce(again, F.lit(False))).select(*_KEY, "at", hash_at.alias("mark"))


def _recurring(listed: DataFrame) -> DataFrame:
    """(doc_id, th, at): the places, ascending, of the window minima whose line hash is selected elsewhere too."""
    places = stored(_minima(listed), "minima")
    # A place may come twice; places differ if one of the parts of their keys does.
    differ = [F.min(c) != F.max(c) for c in ["th", "at", "doc_id", F.col("doc_id").isNull()]]
    # Written, so that the join has a plain exchange on either side and a very
    # common line can be split.
    some = F.coalesce(differ[0] | differ[1] | differ[3], F.lit(False)) | F.coalesce(differ[2], F.lit(False))
    marks = stored(places.groupBy("mark").agg(some.alias("recurs")).where("recurs").select("mark"), "marks")
    return places.join(marks, "mark", "left_semi").groupBy(*_KEY).agg(F.array_sort(F.collect_set("at")).alias("at"))


def _following(at: Column) -> Column:
    """For each line up to the last of ``at``, which ascend, the place of ``at`` that is there or comes next."""
    before = lambda k: F.coalesce(F.get(at, k - 1), F.lit(-1))
    return F.flatten(F.transform(at, lambda p, k: F.array_repeat(p, p - before(k))))


def _extended(listed: DataFrame, recurring: DataFrame) -> DataFrame:
    """(doc_id, th, mark, gram, s, e): the windows around recurring minima, and these
    windows with the lines on either side that take another 20 words' run to reach.
    """
    near = listed.join(recurring, _same(listed, recurring, _KEY)).drop(recurring["doc_id"], recurring["th"])
    rows = _by_word(near.withColumn("following", _following(F.col("at"))), "cut", "following")
    kept, p, w, reach = [*_KEY, "h", "cut", "following"], F.col("p"), F.col("w"), MIN_WORDS - 1
    is_first, is_last = _before(w) == 0, _after(w) == 0
    rows = rows.where(is_first | is_last)
    rows = rows.select(*kept, "own", "p", "w", F.when(is_first, _word(p + reach)).alias("to"), F.when(is_last, _word(p - reach)).alias("since"))
    to, since = F.col("to"), F.col("since")

    def run(first: Column, last: Column, begin: Column, end: Column) -> Column:
        return F.struct(first.alias("first"), last.alias("last"), begin.alias("begin"), end.alias("end"))

    # A run that is shortest from one end holds a single window, at its other end.
    forwards = run(_line(w), _line(to), _line(_word(p + _after(to))), _line(to))
    backwards = run(_line(since), _line(w), _line(since), _line(_word(p - _before(since))))
    both = F.array(F.when(to.isNotNull(), forwards), F.when(since.isNotNull(), backwards))
    rows = rows.select(*kept, "to", F.posexplode(both).alias("way", "w"))
    rows = rows.select(*kept, "way", "w.*").where("way = 0 and first is not null or way = 1 and end < last")
    begin, end = F.col("begin"), F.col("end")
    windows = F.array(_lines_of(begin, end - begin + 1))
    rows = rows.select(*kept, "first", "last", "begin", F.explode(windows).alias("window"))
    at = _lowest(begin, F.col("window"))
    rows = rows.where(F.get("following", at).eqNullSafe(at))
    first, last = F.col("first"), F.col("last")
    rows = rows.select(*_KEY, "cut", "first", "last", _lines_of(first, last - first + 1).alias("run"))
    return rows.select(
        *_KEY,
        F.array_min("run").alias("mark"),
        F.xxhash64("run").alias("gram"),
        F.get("cut", first).alias("s"),
        (F.get("cut", last + 1) - 1).alias("e"),
    )


def _later(runs: DataFrame) -> DataFrame:
    """(doc_id, th, s, e): the runs that occur more than once, but for the first of each."""
    runs = stored(runs, "windows")
    first = runs.groupBy("mark", "gram").agg(F.min(F.struct(*_KEY, "s")).alias("src"), F.count("*").alias("times"))
    first = stored(first.where("times > 1").drop("times"), "first")
    later = F.expr("not (src.doc_id <=> doc_id and src.th = th and src.s = s)")
    return runs.join(first, ["mark", "gram"]).where(later).select(*_KEY, "s", "e")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, th, runs): for documents with later repeats, their line numbers (s to e, from 0)."""
    listed = stored(_listed(docs), "lines")
    later = _later(_extended(listed, _recurring(listed)))
    # Joined where they overlap or touch.
    order = Window.partitionBy(*_KEY).orderBy("s", "e")
    reached = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    later = later.withColumn("new", F.coalesce(F.col("s") > reached + 1, F.lit(True)).cast("int"))
    later = later.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = later.groupBy(*_KEY, "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return runs.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("runs"))


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return a[names[0]].eqNullSafe(b[names[0]]) & (a[names[1]] == b[names[1]])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with a text without later repeated runs, and removed (array of s, e).

    ``docs`` needs doc_id and text; its other columns stay, but for any that is
    named removed, which is replaced. Lines end at a newline, or at
    ``. ! ?`` and a blank, and are equal if they are but for case and outer blanks.
    Blank lines do not part a run; those after a deleted line go with it, and those
    before the first line of a text with that one.

    A line is deleted if it lies in a run of 20 words or more that also occurs
    earlier, in the order of (doc_id, hash of the text, line); the first occurrence
    of a line stays. All such runs are found, whatever stands around them. Of each
    window, a run of lines that has 20 words but not without its first or its last
    line, the smallest line hash is selected; a repeated run has the same windows at
    all its places, hence the same selected lines. Where a selected line recurs, its
    windows are extended both ways by the lines that they need to reach the edges of
    a run, and compared, by their smallest line hash and a hash of all, with the
    first such run in the corpus: with each kind of surroundings, not with one place.
    removed has what is deleted, in as few pieces as possible.

    Null and empty texts come back unchanged. Rows that repeat doc_id and text are
    one document. A text that is a repeat as a whole becomes empty.
    """
    keep = [c for c in docs.columns if c != "removed"]
    docs = docs.select(*(f"`{c}`" for c in keep))
    runs = stored(repeated_runs(docs), "runs").toDF("_dedup_id", "_dedup_th", "_dedup_runs")
    keyed = docs.withColumn("_dedup_key", F.xxhash64("text"))
    # Merged at any size: what is broadcast would grow with the documents.
    on = keyed["doc_id"].eqNullSafe(runs["_dedup_id"]) & (keyed["_dedup_key"] == runs["_dedup_th"])
    joined = keyed.join(runs.hint("merge"), on, "left")
    found = F.col("_dedup_runs")

    def between(ls: Column, k: Column) -> Column:
        """The lines after run k - 1 and before run k."""
        begin = F.coalesce(F.get(found, k - 1)["e"] + 1, F.lit(0))
        return F.slice(ls, begin + 1, F.coalesce(F.get(found, k)["s"], F.size(ls)) - begin)

    gaps = F.sequence(F.lit(0), F.size(found))
    left = _with(lines(F.col("text")), lambda ls: F.array_join(F.flatten(F.transform(gaps, lambda k: between(ls, k))), ""))
    text = F.when(found.isNull(), F.col("text")).otherwise(left)
    removed = F.coalesce(found, F.array().cast("array<struct<s:int,e:int>>"))
    return joined.select(*(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in keep), removed.alias("removed"))
