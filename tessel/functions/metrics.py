"""Answer and evidence metrics as column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessel.functions import text as T


def squad(x: Column) -> Column:
    """Lower case, without ASCII punctuation, articles and surplus blanks."""
    bare = F.regexp_replace(F.lower(x), r"[!-/:-@\[-`{-~\x{2047}]", "")
    return T.squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def is_number(token: Column) -> Column:
    """What reads as a float, 'nan' and 'inf' among it."""
    return token.rlike(r"(?i)^\s*[+-]?((\d+(_\d+)*\.?\d*|\.\d+)(e[+-]?\d+)?|nan|inf(inity)?)\s*$")


def drop_tokens(x: Column) -> Column:
    """Tokens of the number-aware normalisation: split at blanks and hyphens, numbers as floats, other tokens without punctuation, no articles."""

    def one(token: Column) -> Column:
        bare = F.when(is_number(token), token).otherwise(F.regexp_replace(token, r"[!-/:-@\[-`{-~]", ""))
        return T.let(bare, lambda b: F.when(is_number(b), b.cast("double").cast("string")).otherwise(T.squeeze(F.regexp_replace(b, r"(?U)\b(a|an|the)\b", " "))))

    return F.filter(F.flatten(F.transform(F.transform(F.split(F.lower(x), "[ -]"), one), lambda t: F.split(t, " "))), lambda t: t != "")


def exact(prediction: Column, golds: Column) -> Column:
    """1 if any gold equals the prediction after normalisation; 0 without golds."""
    p = F.array_join(drop_tokens(prediction), " ")
    return T.let(p, lambda v: F.exists(golds, lambda g: F.array_join(drop_tokens(g), " ") == v)).cast("int")


def _f1(same: Column, n_pred: Column, n_gold: Column) -> Column:
    p, r = same / n_pred, same / n_gold
    return F.when((n_pred == 0) | (n_gold == 0), (n_pred == n_gold).cast("double")).when(same == 0, 0.0).otherwise(2 * p * r / (p + r))


def multiset_same(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token lists."""
    count = lambda tokens, t: F.size(F.filter(tokens, lambda x: x == t))
    each = F.transform(F.array_distinct(a), lambda t: F.least(count(a, t), count(b, t)))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def token_f1(pred: Column, gold: Column) -> Column:
    """Multiset F1 of two token lists; two empty lists agree."""
    return T.let(F.struct(pred.alias("p"), gold.alias("g")), lambda x: _f1(multiset_same(x["p"], x["g"]), F.size(x["p"]), F.size(x["g"])))


def hotpot(pred: Column, gold: Column) -> Column:
    """struct(em, precision, recall) of two texts by normalised tokens; a verdict word (yes, no, noanswer) on one side only counts as nothing."""

    def build(x: Column) -> Column:
        tokens = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
        verdict = lambda c: c.isin("yes", "no", "noanswer")
        em = x["p"] == x["g"]
        same = F.when(~em & (verdict(x["p"]) | verdict(x["g"])), 0).otherwise(multiset_same(tokens(x["p"]), tokens(x["g"])))
        share = lambda c: F.coalesce(same / F.nullif(F.size(tokens(c)), F.lit(0)), F.lit(0.0))
        return F.struct(em.cast("int").alias("em"), share(x["p"]).alias("precision"), share(x["g"]).alias("recall"))

    return T.let(F.struct(squad(pred).alias("p"), squad(gold).alias("g")), build)


def set_f1(pred: Column, gold: Column) -> Column:
    """Set F1 with the number gate, rounded to two places half to even: 0 if the gold has numbers and none of them is predicted."""

    def build(x: Column) -> Column:
        p, g = F.array_distinct(x["p"]), F.array_distinct(x["g"])
        numbers = F.filter(g, is_number)
        gate = (F.size(numbers) == 0) | F.arrays_overlap(numbers, p)
        both = F.size(F.array_intersect(p, g))
        pr = F.when(F.size(p) == 0, 1.0).otherwise(both / F.size(p))
        re = F.when(F.size(g) == 0, 1.0).otherwise(both / F.size(g))
        return F.when(~gate | (pr + re == 0), 0.0).otherwise(F.rint(2 * pr * re / (pr + re) * 100) / 100)

    return T.let(F.struct(pred.alias("p"), gold.alias("g")), build)


def yes_no(prediction: Column, gold: Column) -> Column:
    """1 if the gold token is predicted and its opposite is not."""
    opposite = F.when(gold == "yes", "no").otherwise("yes")
    return (F.array_contains(prediction, gold) & ~F.array_contains(prediction, opposite)).cast("int")


def set_scores(pred: Column, gold: Column) -> Column:
    """struct(em, precision, recall, f1) of two sets given as lists."""
    p, g = F.array_distinct(pred), F.array_distinct(gold)
    tp = F.size(F.array_intersect(p, g))
    pr = F.when(F.size(p) > 0, tp / F.size(p)).otherwise(0.0)
    re = F.when(F.size(g) > 0, tp / F.size(g)).otherwise(0.0)
    f1 = F.when(pr + re > 0, 2 * pr * re / (pr + re)).otherwise(0.0)
    return F.struct(((tp == F.size(p)) & (tp == F.size(g))).cast("int").alias("em"), pr.alias("precision"), re.alias("recall"), f1.alias("f1"))
