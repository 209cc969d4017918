"""Quality rules whose thresholds come from the data (operator 3), in DataFrame operations only.

Each document gets integer measures.  Per language and source, a log-linear quantile sketch (exact
buckets below 64, then 32 buckets for each doubling: a relative error of 1/32) is counted for each
measure.  A sketch is a table of bucket counts, so sketches of other days or shards merge by adding
counts, in any order and with the same result.  Fences come from a group's own quartiles and replace
fixed cutoffs; documents join the fences of their group and are kept if they lie within all of them.
:func:`keep`, the stage of the pipeline, takes :func:`pooled_fences`: there a group of few documents, or one with
its third quartile in the junk, is judged by the merged sketch of its language, and that by the merged sketch of all.

Defined results: a null text counts as empty; null languages and sources form groups of their own;
repeated rows are judged alike; an empty table gives an empty result; other columns are ignored by
:func:`judge` and passed through by :func:`keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, materialise, small, text_of, words_of

#: measure -> least distance of the upper fence above the third quartile.
SLACK = {"symbol_pm": 150, "repeat_pm": 200, "dup_line_pm": 300, "word_len_c": 300}
#: Quartile distances between the third quartile and the upper fence.
REACH = 4
#: Groups and languages of fewer documents are judged by the merged sketch above them.
FEW = 40
#: Copies of the fence table over which documents of one (hot) group are dealt in a shuffled join.
SALTS = 32
#: Fence tables up to this many rows are broadcast.
BROADCAST_ROWS = 50_000
#: Rejected documents up to this many are broadcast to be taken out; more leave by a shuffled join.
BROADCAST_IDS = 1_000_000

SYMBOLS = "#*$%&|<>"


def measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines as _m.* columns.

    Every column of docs stays; the measures are in one struct column ``_m``.
    """
    t = text_of()
    d = docs.withColumn("_w", words_of(t))
    d = d.withColumn("_n", F.size("_w").cast("long"))
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""))
    # hash of each window of three words; the 64-bit values are compared within one document only
    d = d.withColumn(
        "_h",
        F.expr(
            "case when _n < 3 then cast(array() as array<bigint>)"
            " else transform(sequence(0, cast(_n as int) - 3), i -> xxhash64(_w[i], _w[i + 1], _w[i + 2])) end"
        ),
    )
    d = d.withColumn("_twice", F.size(F.array_distinct("_h")) < F.size("_h"))
    d = d.withColumn("_s", F.expr("case when _twice then sort_array(transform(_h, (h, i) -> struct(h as h, i as i))) end"))
    d = d.withColumn(
        "_p", F.expr("array_sort(transform(filter(_s, (x, k) -> x.h = get(_s, k - 1).h or x.h = get(_s, k + 1).h), x -> x.i))")
    )
    covered = F.expr(
        "coalesce(aggregate(_p, struct(0L as n, -3 as last),"
        " (a, i) -> struct(a.n + least(3, i - a.last) as n, i as last), a -> a.n), 0L)"
    )
    strip = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    m = F.struct(
        F.col("_n").alias("n_words"),
        (F.length(t) - strip(SPACES)).cast("long").alias("word_chars"),
        strip(SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
    )
    return d.withColumn("_m", m).drop("_w", "_n", "_lines", "_h", "_twice", "_s", "_p")


def _rates(m: str = "_m") -> dict[str, Column]:
    n = f"greatest({m}.n_words, 1L)"
    return {
        "symbol_pm": F.expr(f"1000 * {m}.n_symbols div {n}"),
        "repeat_pm": F.expr(f"1000 * {m}.n_repeat_words div {n}"),
        "dup_line_pm": F.expr(f"1000 * {m}.n_dup_lines div greatest({m}.n_lines, 1L)"),
        "word_len_c": F.expr(f"100 * {m}.word_chars div {n}"),
    }


def base_failed(m: str = "_m") -> Column:
    return F.expr(f"{m}.n_words < 50 or 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def bucket(v: str) -> str:
    """SQL for the sketch bucket of a whole number of 0 or more."""
    e = f"(length(bin({v})) - 6)"
    return f"case when {v} < 64 then {v} else {e} * 32 + shiftright({v}, {e}) end"


def low_end(b: str) -> str:
    """SQL for the least value of a bucket."""
    e = f"({b} div 32 - 1)"
    return f"case when {b} < 64 then {b} else shiftleft({b} - {e} * 32, cast({e} as int)) end"


def sketch(measured: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, measure, bucket, n) over documents that pass the base rules."""
    r = measured.filter(~base_failed()).select("lang", "source", *[v.alias(k) for k, v in _rates().items()])
    pairs = ", ".join(f"'{k}', {k}" for k in SLACK)
    r = r.selectExpr("lang", "source", f"stack({len(SLACK)}, {pairs}) as (measure, v)")
    return r.selectExpr("lang", "source", "measure", f"{bucket('v')} as bucket").groupBy("lang", "source", "measure", "bucket").agg(
        F.count("*").alias("n")
    )


def merge(*sketches: DataFrame) -> DataFrame:
    """The sketch of all that went into the given sketches."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy("lang", "source", "measure", "bucket").agg(F.sum("n").alias("n"))


def _limits(sk: DataFrame, *group: str) -> DataFrame:
    """(the group's columns, measure, total, q1, q3, low, high) from bucket counts."""
    from pyspark.sql import Window

    key = [*group, "measure"]
    w = Window.partitionBy(*key)
    c = sk.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("bucket")))
    q = c.groupBy(*key).agg(at(1).alias("b1"), at(3).alias("b3"), F.max("total").alias("total"))
    q = q.selectExpr(*key, "total", f"{low_end('b1')} as q1", f"{low_end('b3')} as q3")
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    spread = F.greatest(F.lit(REACH) * (F.col("q3") - F.col("q1")), slack[F.col("measure")].cast("long"))
    return q.withColumn("high", F.col("q3") + spread).withColumn("low", F.col("q1") - spread)


def _in_columns(limits: DataFrame) -> DataFrame:
    pick = lambda name, m: F.max(F.when(F.col("measure") == m, F.col(name)))
    return limits.groupBy("lang", "source").agg(
        *[pick("high", m).alias(f"high_{m}") for m in SLACK], pick("low", "word_len_c").alias("low_word_len_c")
    )


def fences(sk: DataFrame) -> DataFrame:
    """(lang, source, one column high_<measure> each, low_word_len_c) from bucket counts."""
    return _in_columns(_limits(sk, "lang", "source"))


def pooled_fences(sk: DataFrame) -> DataFrame:
    """:func:`fences`, where groups that can't be judged by themselves have those of their language, or of all.

    Such a group has fewer than FEW documents, or only one of its quartiles lies within the fence above it: it is
    then a mixture.  A group with both quartiles beyond that fence is uniform and keeps its own.
    """
    sk = materialise(sk)
    total = lambda *key: sk.groupBy(*key, "measure", "bucket").agg(F.sum("n").alias("n"))
    names = ("total", "q1", "q3", "low", "high")
    every = _limits(total()).select("measure", *[F.col(c).alias(f"all_{c}") for c in names])
    sound = lambda c, above: F.expr(
        f"{c}total >= {FEW} and not ({c}q1 <= {above}high and {c}q3 > {above}high)"
        f" and not (measure = 'word_len_c' and {c}q1 < {above}low and {c}q3 >= {above}low)"
    )
    lang = _limits(total("lang"), "lang").join(F.broadcast(every), "measure")
    for c in ("low", "high"):
        lang = lang.withColumn(f"up_{c}", F.when(sound("", "all_"), F.col(c)).otherwise(F.col(f"all_{c}")))
    lang = materialise(lang.select(F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), "up_low", "up_high"))
    on = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))
    own = _limits(sk, "lang", "source").join(small(lang, BROADCAST_ROWS), on)
    ok = sound("", "up_")
    own = own.select("lang", "source", "measure", *[F.when(ok, F.col(c)).otherwise(F.col(f"up_{c}")).alias(c) for c in ("low", "high")])
    return _in_columns(own)


def _judged(measured: DataFrame, table: DataFrame) -> DataFrame:
    """measured with a boolean column _kept; a group without fences keeps what passes the base rules."""
    f = table.select(F.col("lang").alias("_fl"), F.col("source").alias("_fs"), *[c for c in table.columns if c not in ("lang", "source")])
    on = F.col("lang").eqNullSafe(F.col("_fl")) & F.col("source").eqNullSafe(F.col("_fs"))
    hinted = small(f, BROADCAST_ROWS)
    if hinted is f:  # too many groups to broadcast: a shuffled join, each group's documents dealt over SALTS tasks
        hinted = f.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        measured = measured.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        on = on & (F.col("_slot") == F.col("_salt"))
    r = _rates()
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & (r[m] <= F.coalesce(F.col(f"high_{m}"), r[m]))
    inside = inside & (r["word_len_c"] >= F.coalesce(F.col("low_word_len_c"), r["word_len_c"]))
    out = measured.join(hinted, on, "left").withColumn("_kept", ~base_failed() & inside)
    return out.drop("_fl", "_fs", "_salt", "_slot", *[c for c in table.columns if c not in ("lang", "source")])


def judge(docs: DataFrame, fenced=fences) -> DataFrame:
    """One row per document: doc_id, the measures, base_failed, kept; fenced is :func:`fences` or :func:`pooled_fences`."""
    m = materialise(measures(docs.select("doc_id", "text", "lang", "source")).drop("text"))
    out = _judged(m, materialise(fenced(sketch(m))))
    return out.select("doc_id", "_m.n_words", "_m.word_chars", "_m.n_symbols", "_m.n_dup_lines", "_m.n_repeat_words",
                      base_failed().alias("base_failed"), F.col("_kept").alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their columns, whose document is kept within the pooled fences.

    Measures are made once, without the texts; what is rejected leaves by an anti-join on doc_id and text hash.
    """
    own = docs.select("doc_id", "text", "lang", "source", F.xxhash64(text_of()).alias("_th"))
    m = materialise(measures(own).drop("text"))
    out = _judged(m, materialise(pooled_fences(sketch(m)))).filter(~F.col("_kept"))
    gone = materialise(out.select(F.col("doc_id").alias("_gd"), F.col("_th").alias("_gh")).distinct())
    on = F.col("doc_id").eqNullSafe(F.col("_gd")) & (F.xxhash64(text_of()) == F.col("_gh"))
    return docs.join(small(gone, BROADCAST_IDS), on, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
