"""Words of a corpus: how often they occur, beside which others, and where spaces stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.scalars import PARTICLES, stem, word_core
from quire.operators.ranks import at_ranks


def line_tokens(lines: DataFrame) -> DataFrame:
    """(doc_id, line_no, pos, n, token): the parts of lines between spaces and tabs, from 0, with their cores; n parts in the line."""
    parts = lines.withColumn("parts", F.split("text", "[ \t]"))
    each = parts.select("doc_id", "line_no", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "raw"))
    return each.select("doc_id", "line_no", "pos", "n", word_core("raw").alias("token"))


def token_counts(lines: DataFrame) -> DataFrame:
    """(token, n_all, n_inner): occurrences of each token anywhere, and not at a line's ends.

    Parts are counted as they stand; only the distinct ones are cut to their cores and counted again.
    """
    parts = lines.select(F.split("text", "[ \t]").alias("parts")).select(F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "raw"))
    raw = parts.filter("raw <> ''").groupBy("raw").agg(F.count("*").alias("n_all"), F.count_if(F.col("pos").between(1, F.col("n") - 2)).alias("n_inner"))
    return raw.groupBy(word_core("raw").alias("token")).agg(F.sum("n_all").alias("n_all"), F.sum("n_inner").alias("n_inner")).filter("token <> ''")


def dictionary(lines: DataFrame) -> DataFrame:
    """(token, n_all, n_inner, n_stem): occurrences anywhere, not at a line's ends, and of inner tokens with this stem.

    A line's first and last parts may be cut by the line's end, so they don't count as inner tokens.
    """
    # a token counts for itself and, inside lines, for its stem: one pass over the text
    zero = F.lit(0).cast("long")
    own = F.struct("token", "n_all", "n_inner", zero.alias("n_stem"))
    stems = F.when(F.col("n_inner") > 0, F.array(F.struct(stem("token").alias("token"), zero.alias("n_all"), zero.alias("n_inner"), F.col("n_inner").alias("n_stem"))))
    each = token_counts(lines).select(F.explode(F.concat(F.array(own), F.coalesce(stems, F.array().cast("array<struct<token:string,n_all:bigint,n_inner:bigint,n_stem:bigint>>")))).alias("t"))
    return each.groupBy("t.token").agg(*(F.sum(f"t.{c}").alias(c) for c in ("n_all", "n_inner", "n_stem")))


def token_pairs(lines: DataFrame, least: int = 2) -> DataFrame:
    """(left, right, n): neighbouring words of lines that stand together at least `least` times."""
    words = F.filter(F.transform(F.split("text", r"[ \t]+"), word_core), lambda w: w != "")
    # a line without words has no pairs: a slice of a negative length is an error
    pairs = lines.select(words.alias("w")).select(F.explode(F.arrays_zip(F.expr("slice(w, 1, greatest(size(w) - 1, 0))").alias("left"), F.expr("slice(w, 2, size(w))").alias("right"))).alias("p"))
    return pairs.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def space_rates(lines: DataFrame) -> DataFrame:
    """(c, n_after, spaced_after, n_before, spaced_before): how often a space stands behind or before a letter or digit.

    Pairs with a sign on either side are left out.
    """
    # a look ahead takes the two characters from each place on; one pass, whatever a line's length
    grams = lines.select(F.explode(F.regexp_extract_all("text", F.lit("(?s)(?=(..))"), 1)).alias("g"))
    counted = grams.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("g").rlike(r"^[\p{L}\p{N} ]{2}\z"))
    side = lambda at, other: counted.filter(F.substring("g", at, 1) != " ").groupBy(F.substring("g", at, 1).alias("c")).agg(F.sum("n").alias("n"), F.sum(F.when(F.substring("g", other, 1) == " ", F.col("n")).otherwise(0)).alias("spaced"))
    after, before = side(1, 2), side(2, 1)
    zero = lambda x: F.coalesce(x, F.lit(0))
    joined = after.alias("a").join(before.alias("b"), F.col("a.c") == F.col("b.c"), "full_outer")
    return joined.select(F.coalesce("a.c", "b.c").alias("c"), zero(F.col("a.n")).alias("n_after"), zero(F.col("a.spaced")).alias("spaced_after"), zero(F.col("b.n")).alias("n_before"), zero(F.col("b.spaced")).alias("spaced_before"))


def word_families(words: DataFrame, counted: DataFrame) -> DataFrame:
    """(base, n): how often each base of words occurs in counted (token, n_all), alone or with a particle."""
    forms = words.select("base", F.explode(F.array(F.col("base"), *(F.concat("base", F.lit(p)) for p in PARTICLES))).alias("token"))
    found = forms.join(counted, "token", "left").groupBy("base").agg(F.sum(F.coalesce("n_all", F.lit(0))).alias("n"))
    return found.select("base", F.when(F.length("base") < 2, 0).otherwise(F.col("n")).alias("n"))


def line_start_families(lines: DataFrame) -> DataFrame:
    """(base, n): the same for each word that begins a line, against all words: a word counts for itself and for what it is without
    a particle, so the text is read once and no word meets all others."""
    parts = lines.select(F.posexplode(F.split("text", "[ \t]")).alias("pos", "raw")).filter("raw <> ''")
    raw = parts.groupBy("raw").agg(F.count("*").alias("n_all"), F.count_if(F.col("pos") == 0).alias("n_first"))
    counted = raw.select(word_core("raw").alias("token"), "n_all", "n_first").filter("token <> ''").groupBy("token").agg(F.sum("n_all").alias("n_all"), F.sum("n_first").alias("n_first"))
    t, zero = F.col("token"), F.lit(0).cast("long")
    bases = [F.struct(t.alias("base"), "n_all", "n_first")] + [F.when(t.endswith(p) & (F.length(t) > len(p)), F.struct(F.left(t, F.length(t) - len(p)).alias("base"), F.col("n_all").alias("n_all"), zero.alias("n_first"))) for p in PARTICLES]
    found = counted.select(F.explode(F.array_compact(F.array(*bases))).alias("b")).groupBy("b.base").agg(F.sum("b.n_all").alias("n"), F.sum("b.n_first").alias("k")).filter("k > 0")
    return found.select("base", F.when(F.length("base") < 2, 0).otherwise(F.col("n")).alias("n"))


def spacing_scale(gaps: DataFrame, enough: int = 15) -> DataFrame:
    """(doc_id, word, syllable): a document's usual gap at written spaces (src = model), and the upper one inside words.

    gaps: doc_id, p (chance of a space), g (gap by height), src. Few observations give the usual 0.5 and 0.33.
    """
    kind = F.when(F.col("src") == "model", "word").when(F.col("src").isNull() & (F.col("p") < 0.01), "syllable")
    ranked = at_ranks(gaps.select("doc_id", kind.alias("kind"), "g"), ["doc_id", "kind"], "g", word=lambda n: F.floor(n / 2), syllable=lambda n: F.least(n - 1, F.floor(n * 0.9)))
    pick = lambda k, usual: F.coalesce(F.max(F.when((F.col("kind") == k) & (F.col("n") >= enough), F.col(k))), F.lit(usual)).alias(k)
    return ranked.groupBy("doc_id").agg(pick("word", 0.5), pick("syllable", 0.33))


def joined_evidence(lines: DataFrame) -> DataFrame:
    """(left, right, n_apart, n_joined): neighbouring words, how often they stand apart, and how often as one word."""
    apart = token_pairs(lines, 1).withColumnRenamed("n", "n_apart")
    whole = token_counts(lines).select(F.col("token").alias("both"), F.col("n_all").alias("n_joined"))
    return apart.join(whole, F.concat("left", "right") == F.col("both")).select("left", "right", "n_apart", "n_joined")

