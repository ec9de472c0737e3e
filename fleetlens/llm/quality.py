"""Quality rules by weak supervision, with DataFrame functions only.

Each rule votes good (1), bad (0) or abstains (null) on a document.  Documents are
pre-aggregated to counts of vote patterns - at most 3 ** rules rows, whatever the input -
on which expectation-maximisation estimates, per rule and true class, how often it votes either
way or abstains (its accuracy), and the share of good documents.  The posterior probability of each pattern then
goes back to its documents by a join on the pattern.

Defined results: a null or empty text has no words, fails the base rules and is not kept;
repeated rows are judged row by row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from fleetlens.llm.scratch import Scratch
from fleetlens.llm.words import WORD

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
ITERATIONS = 30
#: pseudo votes behind each rate, so that no estimate is exactly 0 or 1
SMOOTH = 0.5
#: posterior before the first step: documents without, and with, a vote for bad
NO_BAD, SOME_BAD = 0.9, 0.1


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the helpers of the rules."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    worded = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(WORD)))
    a = df.withColumn("_text", text).withColumn("_w", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0))).withColumn("_lines", worded)
    a = a.withColumn("n_words", F.size("_w").cast("long"))
    a = a.withColumn("_windows", F.when(F.col("n_words") < 3, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3),
        lambda i: F.concat_ws(" ", F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))))
    # only texts that do repeat a window need to know where: sort windows with their places, and
    # keep the places of those that equal a neighbour
    a = a.withColumn("_repeats", F.size("_windows") > F.size(F.array_distinct("_windows")))
    placed = F.when(F.col("_repeats"), F.sort_array(F.transform("_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    a = a.withColumn("_sorted", placed)
    places = F.sort_array(F.transform(
        F.filter("_sorted", lambda p, i: (p["x"] == F.get("_sorted", i + 1)["x"]) | (p["x"] == F.get("_sorted", i - 1)["x"])),
        lambda p: p["i"]))
    a = a.withColumn("_places", F.when(F.col("_repeats"), places))
    covered = F.aggregate(F.transform("_places", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("_places", i + 1) - p, F.lit(3)))),
                          F.lit(0), lambda total, x: total + x)
    return a.select(
        *df.columns, "n_words",
        (F.length("_text") - F.regexp_count("_text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("_repeats"), covered), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit("!")).cast("long").alias("n_exclaim"))


def default_rules() -> list[Column]:
    """Votes on the features of ``text_features``: 0 bad, 1 good, null abstains.

    Five rules know one kind of junk each and abstain on everything else; word length votes
    both ways; the last one vouches for plain prose.
    """
    n, chars, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    enough = n >= 20
    symbols = enough & (10 * F.col("n_symbols") > 2 * n)
    repeats = enough & (10 * F.col("n_repeat_words") > 3 * n)
    copied = (lines >= 4) & (10 * F.col("n_dup_lines") > 4 * lines)
    shouts = enough & (10 * F.col("n_upper") > 3 * chars)
    exclaims = enough & (10 * F.col("n_exclaim") > 4 * n)
    odd = enough & ((2 * chars < 5 * n) | (chars > 12 * n))
    usual = enough & (2 * chars >= 7 * n) & (chars <= 8 * n)
    plain = enough & (100 * F.col("n_symbols") <= n) & (100 * F.col("n_repeat_words") <= 5 * n) & (F.col("n_dup_lines") == 0) & (
        100 * F.col("n_upper") <= 6 * chars) & (100 * F.col("n_exclaim") <= 5 * n)
    bad, good = F.lit(0).cast("tinyint"), F.lit(1).cast("tinyint")
    return [*(F.when(x, bad) for x in (symbols, repeats, copied, shouts, exclaims)), F.when(odd, bad).when(usual, good), F.when(plain, good)]


def posteriors(patterns: DataFrame, rules: int, iterations: int = ITERATIONS) -> DataFrame:
    """(votes, posterior) from (votes, n): EM over a bounded list of patterns, as one expression."""
    one = patterns.agg(F.sort_array(F.collect_list(F.struct("votes", F.col("n").cast("double").alias("n")))).alias("p"))
    start = F.transform("p", lambda x: F.when(F.exists(x["votes"], lambda v: v == 0), F.lit(SOME_BAD)).otherwise(F.lit(NO_BAD)))

    def total(q: Column, weight) -> Column:
        return F.aggregate(F.transform("p", lambda x, i: x["n"] * weight(F.get(q, i), x)), F.lit(0.0), lambda s, x: s + x)

    def model(q: Column) -> Column:
        """Share of good documents, and per rule how often either class gets its vote for bad, for good, or none."""
        def rates(share) -> Column:
            mass = total(q, lambda z, x: share(z))
            return F.array(*(F.array(*((total(q, lambda z, x, r=r, v=v: F.when(
                F.coalesce(F.get(x["votes"], F.lit(r)).cast("int"), F.lit(2)) == v, share(z)).otherwise(0.0)) + SMOOTH) / (mass + 3 * SMOOTH)
                for v in range(3))) for r in range(rules)))

        prior = (total(q, lambda z, x: z) + SMOOTH) / (total(q, lambda z, x: F.lit(1.0)) + 2 * SMOOTH)
        return F.struct(prior.alias("prior"), rates(lambda z: z).alias("good"), rates(lambda z: 1 - z).alias("bad"))

    def judge(m: Column, x: Column) -> Column:
        odds = F.log(m["prior"]) - F.log(1 - m["prior"])
        for r in range(rules):
            v = F.coalesce(F.get(x["votes"], F.lit(r)).cast("int"), F.lit(2))
            odds = odds + F.log(F.get(F.get(m["good"], F.lit(r)), v)) - F.log(F.get(F.get(m["bad"], F.lit(r)), v))
        return 1 / (1 + F.exp(-odds))

    def step(q: Column) -> Column:
        # the one-element array binds the model, so that it is worked out once a step
        return F.get(F.transform(F.array(model(q)), lambda m: F.transform("p", lambda x: judge(m, x))), F.lit(0))

    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, lambda q, _: step(q))
    both = one.where(F.size("p") > 0).select("p", fitted.alias("q")).select(F.explode(F.arrays_zip("p", "q")).alias("z"))
    return both.select(F.col("z.p.votes").alias("votes"), F.col("z.q").alias("posterior"))


def score(df: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
          rules: Sequence[Column] | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per document: id, the features, base_failed, posterior and kept."""
    rules = default_rules() if rules is None else list(rules)
    f = text_features(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    f = f.drop("text").withColumn("votes", F.array(*rules))
    f = scratch.write(f, "features")
    fitted = posteriors(f.groupBy("votes").agg(F.count("*").alias("n")), len(rules))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # votes hold nulls: compare them as text; at most 3 ** rules patterns are broadcast
    key = F.to_json(F.struct("votes"))
    judged = f.withColumn("_key", key).join(F.broadcast(fitted.select(key.alias("_key"), "posterior")), "_key", "left")
    return judged.select(F.col("doc_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         failed.alias("base_failed"), (~failed & (F.col("posterior") >= threshold)).alias("kept"), "posterior", "votes")
