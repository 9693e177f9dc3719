"""Line de-duplication by a suffix array over line numbers.

Lines become numbers, documents become sequences of numbers, and the suffixes of all
sequences are sorted by distributed prefix doubling. Runs of lines that begin several
suffixes are the longest-common-prefix intervals of that order; the first copy of a
repeated run stays, later copies are deleted.

* Blank lines are left out of the sequences and always stay. A line that occurs once
  can't be in a repeated run, so sequences are cut there; what remains are stretches.
* Level 0 ranks a suffix by its first line. A round takes the rank over 2^k lines to
  2^(k+1): a suffix is ordered, within its group of equal ranks, by the rank of the
  suffix 2^k lines on. Its new rank is that of the group plus the number of members
  that sort before it. Only distinct (rank, next rank) pairs are sorted, after a
  pre-aggregated count, and a large group is divided by the next rank into ranges, so
  a line that a third of the corpus shares is not sorted in one task.
* A run counts as repeated if it has at least ``min_words`` words. Each line has one
  shortest such run that begins with it, and one that ends with it; a repeated run is
  the union of the ones it holds. Since a line outside blank ones has a word, the
  shortest run has at most ``min_words`` lines; doubling stops when two overlapping
  prefixes of the last level cover it. Suffixes whose common prefix covers such a run
  agree in it: the interval is named by the length and the two ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, col, free_name

KEY = ("k1", "k2")
ROWS_PER_RANGE = 100_000


def text_key(id_col: str, text_col: str) -> list[Column]:
    """128 bits that stand for a row: id and text. Rows equal in both share a key."""
    text = col(text_col).cast("string")
    return [F.xxhash64(F.lit(n), col(id_col), text).alias(name) for n, name in enumerate(KEY)]


def words(line: Column) -> Column:
    return F.regexp_count(line, F.lit("[^\\x20\\x09-\\x0D]+"))


def _ranked(pairs: DataFrame, ranges: Column, divide: Column) -> DataFrame:
    """``pairs(r1, r2, n)`` with ``before``: the members of group r1 with smaller r2, and
    with ``n`` kept. ``divide`` numbers the ranges of r2 of a group, ``ranges`` says how
    many the group has; both only depend on the pair and the size of its group."""
    part = pairs.withColumn("range", F.when(ranges > 1, divide).otherwise(0))
    own = Window.partitionBy("r1", "range").orderBy("r2").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("inner", F.coalesce(F.sum("n").over(own), F.lit(0)))
    earlier = Window.partitionBy("r1").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = (part.where(ranges > 1).groupBy("r1", "range").agg(F.sum("n").alias("t"))
            .withColumn("base", F.coalesce(F.sum("t").over(earlier), F.lit(0))).drop("t"))
    return (part.join(base, ["r1", "range"], "left")
            .withColumn("before", F.coalesce("base", F.lit(0)) + F.col("inner")).drop("base", "inner", "range"))


def _sequences(scratch: Scratch, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, id, line, h1, h2, words) of the non-blank lines, once per distinct row."""
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    line = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2"),
                                 words(x).alias("words"))
    own = docs.select(*text_key(id_col, text_col), col(id_col).alias("id"),
                      F.filter(F.transform(F.split(text, "\n"), line), lambda x: x["words"] > 0).alias("lines"))
    own = own.groupBy(*KEY).agg(F.min("id").alias("id"), F.first("lines").alias("lines"))
    return scratch.keep(own.select(*KEY, "id", F.explode("lines").alias("l")).select(*KEY, "id", "l.*"), "lines")


def suffixes(scratch: Scratch, lines: DataFrame, levels: int) -> DataFrame:
    """The suffixes of the stretches of repeated lines: (k1, k2, id, line, stretch, pos,
    words, r0 .. r<levels>), where two suffixes have the same ``r<k>`` if and only if
    they share their first 2^k lines (or end alike before), and ranks follow the order
    of the suffixes."""
    n = lines.count()
    count = lines.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1")
    # Level 0 is one group of all lines, ordered by the hash and divided by its top bits.
    width = max(0, (max(1, n) // ROWS_PER_RANGE).bit_length())
    zero = count.select(F.lit(0).alias("r1"), F.struct("h1", "h2").alias("r2"), "n")
    top = F.shiftright("r2.h1", 63 - width) if width else F.lit(0)
    zero = _ranked(zero, F.lit(2), top).select("r2.h1", "r2.h2", (F.col("before") + 1).alias("r0"), F.col("n").alias("size"))
    known = lines.join(zero, ["h1", "h2"], "left").select(*KEY, "id", "line", "words", "r0", "size")
    order = Window.partitionBy(*KEY).orderBy("line")
    # A stretch has the number of single lines before it; those lines go.
    cut = known.withColumn("stretch", F.count(F.when(F.col("r0").isNull(), 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.where("r0 is not null")
    run = Window.partitionBy(*KEY, "stretch").orderBy("line")
    cut = cut.withColumn("pos", F.row_number().over(run))
    state = scratch.keep(cut, "level0")
    ranks = ["r0"]
    for k in range(levels):
        now, new = f"r{k}", f"r{k + 1}"
        # 0: the stretch ends before; it sorts first.
        ahead = state.withColumn("next", F.coalesce(F.lead(now, 1 << k).over(run), F.lit(0)).cast("long"))
        ahead = scratch.keep(ahead, f"ahead{k}")
        pairs = ahead.groupBy(F.col(now).alias("r1"), F.col("next").alias("r2")).agg(F.count("*").alias("n"), F.first("size").alias("size"))
        ranges = F.ceil(F.col("size") / F.lit(ROWS_PER_RANGE))
        divide = F.floor(F.col("r2") * ranges / F.lit(n + 1))
        named = _ranked(pairs, ranges, divide).select(F.col("r1").alias(now), F.col("r2").alias("next"),
                                                      (F.col("r1") + F.col("before")).alias(new), F.col("n").alias("own"))
        state = scratch.keep(ahead.join(named, [now, "next"]).select(
            *KEY, "id", "line", "words", "stretch", "pos", *ranks, new, F.col("own").alias("size")), f"level{k + 1}")
        scratch.drop(f"level{k}")
        scratch.drop(f"ahead{k}")
        ranks.append(new)
    return state


def repeated_runs(scratch: Scratch, lines: DataFrame, min_words: int) -> DataFrame:
    """(k1, k2, line): the lines inside later copies of repeated runs."""
    levels = max(0, min_words.bit_length() - 1)  # 2^levels <= min_words < 2^(levels + 1)
    tree = suffixes(scratch, lines, levels)
    run = Window.partitionBy(*KEY, "stretch")
    order = run.orderBy("line")
    done = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0))
    tree = tree.withColumn("to", done.cast("long")).withColumn("from", F.col("to") - F.col("words"))
    # Lines of the shortest run of min_words words that starts, or ends, at a line.
    ahead = F.count("*").over(run.orderBy("from").rangeBetween(1, min_words - 1)) + 1
    behind = F.count("*").over(run.orderBy("to").rangeBetween(-(min_words - 1), -1)) + 1
    tree = (tree.withColumn("ahead", F.when(F.max("to").over(run) - F.col("from") >= min_words, ahead))
            .withColumn("behind", F.when(F.col("to") >= min_words, behind)))
    ranks = [f"r{k}" for k in range(levels + 1)]
    stretch = tree.groupBy(*KEY, "id", "stretch").agg(
        F.sort_array(F.collect_list(F.struct("pos", "line", "ahead", "behind", F.array(*ranks).alias("ranks")))).alias("s"))
    # Both kinds of runs as (start, length), and their interval: length and two ranks.
    starts = F.filter(F.transform("s", lambda x: F.struct(x["pos"].alias("at"), x["ahead"].cast("int").alias("n"))), lambda w: w["n"].isNotNull())
    ends = F.filter(F.transform("s", lambda x: F.struct((x["pos"] - x["behind"].cast("int") + 1).alias("at"), x["behind"].cast("int").alias("n"))),
                    lambda w: w["n"].isNotNull())
    level = lambda n: F.floor(F.log2(n.cast("double")) + 1e-9).cast("int")
    rank = lambda at, k: F.element_at(F.element_at(F.col("s"), at)["ranks"], k + 1)
    named = F.transform(F.array_distinct(F.concat(starts, ends)), lambda w: F.struct(
        w["n"].alias("n"), rank(w["at"], level(w["n"])).alias("a"),
        rank(w["at"] + w["n"] - F.pow(F.lit(2.0), level(w["n"])).cast("int"), level(w["n"])).alias("b"),
        F.element_at(F.col("s"), w["at"])["line"].alias("line"),
        F.transform(F.slice(F.col("s"), w["at"], w["n"]), lambda x: x["line"]).alias("covers")))
    spans = scratch.keep(stretch.select(*KEY, "id", F.explode(named).alias("w")).select(*KEY, "id", "w.*"), "spans")
    place = F.struct("id", *KEY, "line")
    groups = spans.groupBy("n", "a", "b").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    groups = scratch.keep(groups.select("n", "a", "b", "first"), "groups")
    later = spans.join(groups, ["n", "a", "b"]).where(~place.eqNullSafe(F.col("first")))
    return later.select(*KEY, F.explode("covers").alias("line"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20,
                lines_name: str = "deleted_lines") -> DataFrame:
    """``docs`` with repeated line runs deleted from the text, and ``deleted_lines``, the
    numbers (from 0) of the deleted lines in order.

    A run of lines (blank ones aside) of at least ``min_words`` words that occurs earlier
    in the corpus, by id and line, is deleted. All rows stay, with the empty text if all
    lines go.

    Defined cases: a null text stays null; rows equal in id and text are one document
    read twice and get the same text; a null id comes before all others; ties between
    documents of one id are broken by a hash of the text; an empty table gives an empty
    result; other columns pass through, and one that is called like the result column is
    an error.
    """
    if lines_name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the documents already have {lines_name!r}; choose another name")
    scratch = Scratch(docs.sparkSession, "lineruns")
    lines = _sequences(scratch, docs, id_col, text_col)
    gone = repeated_runs(scratch, lines, min_words).groupBy(*KEY).agg(F.sort_array(F.collect_set("line")).alias("gone"))
    k1, k2, g = (free_name(docs, x) for x in ("k1", "k2", "gone"))
    gone = scratch.keep(gone.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("gone").alias(g)), "gone")
    own = text_key(id_col, text_col)
    keyed = docs.select("*", own[0].alias(k1), own[1].alias(k2)).join(gone.hint("shuffle_hash"), [k1, k2], "left")
    split = F.split(col(text_col).cast("string"), "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(g))
    text = F.when(F.col(g).isNull(), col(text_col)).otherwise(
        F.array_join(F.transform(left, lambda i: F.element_at(split, i + 1)), "\n"))
    return keyed.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns],
                        F.coalesce(F.col(g), F.array().cast("array<int>")).alias(lines_name))
