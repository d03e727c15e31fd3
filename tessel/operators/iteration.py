"""The multi-hop iteration over stored scores: dense retrieval, stage one, stage two and the stop rule for every active query, hop by hop."""

from __future__ import annotations

import argparse
import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import cut


@dataclass(frozen=True)
class Steps:
    """Parameters of a hop."""

    hops: int = 4
    beam: int = 4  # paragraphs of the dense step
    topk: int = 9  # sentences of stage one, those carried among them
    ratio: float = 0.5  # share of the paragraph score in stage one
    topk_two: int = 5
    min_take: int = 2
    thresh: float = 0.1
    enough: float = 0.9
    confident: float = 0.98
    lower: bool = True  # whether falling evidence stops

    @classmethod
    def of_arguments(cls, arguments: list[str]) -> Steps:
        """From command-line arguments; those not given keep their defaults, unknown ones are refused."""
        names = {
            "--max_hops": "hops", "--beam_size": "beam", "--topk": "topk", "--s1_para_sent_ratio": "ratio", "--topk_stage2": "topk_two", "--s2_min_take": "min_take",
            "--s2_sp_thresh": "thresh", "--stop_ev_thresh": "enough", "--stop_ansconfdelta_thresh": "confident",
        }
        parser = argparse.ArgumentParser(exit_on_error=False)
        for flag, name in names.items():
            parser.add_argument(flag, dest=name, type=type(getattr(cls(), name)), default=getattr(cls(), name))
        parser.add_argument("--stop_lowerev", dest="lower", action=argparse.BooleanOptionalAction, default=cls().lower)
        return cls(**vars(parser.parse_args(arguments)))


def _one_hop(now: DataFrame, carried: DataFrame, p: Steps) -> DataFrame:
    """(query_uid, pos, idx, s_idx, sent_uid, s2): the evidence after a hop, from the rows of the hop and what is carried."""
    order = lambda *by: F.row_number().over(Window.partitionBy("query_uid").orderBy(*by))
    paras = now.groupBy("query_uid", "idx").agg(F.max("score").alias("d")).withColumn("rn", order(F.col("d").desc_nulls_last(), "idx")).where(F.col("rn") <= p.beam)
    paras = paras.select("query_uid", "idx").join(carried.select("query_uid", "idx"), ["query_uid", "idx"], "left_anti")  # after the cut, so fewer may be left
    blend = p.ratio * F.col("s1para_score") + (1 - p.ratio) * F.col("score")
    new = now.join(paras, ["query_uid", "idx"]).withColumn("rn", order(blend.desc_nulls_last(), "sent_uid")).where(F.col("rn") <= p.topk)
    again = now.groupBy("query_uid", "idx", "s_idx").agg(F.max("s2").alias("now"))
    kept = carried.join(again, ["query_uid", "idx", "s_idx"], "left").select("query_uid", "pos", "idx", "s_idx", "sent_uid", F.coalesce("now", "s2").alias("s2"))
    held = carried.groupBy("query_uid").agg(F.count("*").alias("held"))
    after = new.join(held, "query_uid", "left").select("query_uid", (F.col("rn") + F.coalesce("held", F.lit(0))).cast("int").alias("pos"), "idx", "s_idx", "sent_uid", "s2")
    one = kept.unionByName(after).where(F.col("pos") <= p.topk)
    ranked = one.withColumn("rank", order(F.col("s2").desc(), "pos"))
    every = Window.partitionBy("query_uid")
    least = F.when(F.count("*").over(every) > p.min_take, F.least(F.lit(p.thresh), F.max(F.when(F.col("rank") == p.min_take, F.col("s2"))).over(every) - 1e-10))
    two = ranked.withColumn("least", least).where("least is null or s2 > least").where(F.col("rank") <= p.topk_two)
    return two.select("query_uid", F.col("rank").alias("pos"), "idx", "s_idx", "sent_uid", "s2")


def iterate(rows: DataFrame, p: Steps | None = None) -> DataFrame:
    """(query_uid, hop, ev, stop_reason, evidence): where every query stops and its sentences (sent_uid) in order, one row per query.

    ``rows`` are the scored sentences of each query and hop (query_uid, hop, idx, s_idx, sent_uid, score, s1para_score, s2_score, s2ev_score); a missing or NaN score ranks last,
    a second-stage score as -1. At each hop the beam's paragraphs that hold no carried sentence are ranked by sentence; the carried sentences come first; the second stage
    scores them anew, takes a few at least and others above a threshold. Reasons: evsuff, aconf, max (the last hop, or none left), evlower. Rows of a hop are read for queries
    that have not stopped; the state is checkpointed every hop.
    """
    p = p or Steps()
    usable = lambda c: F.when(~F.isnan(c), F.col(c))
    scored = rows.where(F.col("hop") < p.hops).select(
        "query_uid", "hop", "idx", "s_idx", "sent_uid", usable("score").alias("score"), usable("s1para_score").alias("s1para_score"),
        F.coalesce(usable("s2_score"), F.lit(-1.0)).alias("s2"), usable("s2ev_score").alias("ev"),
    ).distinct()
    scored = cut(scored.withColumn("last", F.max("hop").over(Window.partitionBy("query_uid"))))
    active = cut(scored.select("query_uid", F.lit(None).cast("double").alias("before")).distinct())
    carried = scored.select("query_uid", F.col("hop").alias("pos"), "idx", "s_idx", "sent_uid", "s2").limit(0)
    out = []
    for hop in range(p.hops):
        now = scored.where(F.col("hop") == hop).join(active, "query_uid")
        evidence = cut(_one_hop(now.drop("before"), carried, p))
        state = now.groupBy("query_uid", "before", "last").agg(F.max("ev").alias("ev"), F.max("score").alias("conf"))
        # a query without rows at this hop goes on as it is
        reasons = F.array_compact(
            F.array(
                F.when(F.col("ev") >= p.enough, F.lit("evsuff")), F.when(F.col("conf") >= p.confident, F.lit("aconf")), F.when(F.col("last") <= hop, F.lit("max")),
                F.when(F.lit(p.lower) & (F.col("before") >= F.col("ev")), F.lit("evlower")),
            )
        )
        state = cut(state.withColumn("stop_reason", reasons))
        stopped = state.where(F.size("stop_reason") > 0)
        lists = evidence.groupBy("query_uid").agg(F.array_sort(F.collect_list(F.struct("pos", "sent_uid"))).alias("e"))
        found = F.coalesce(F.transform("e", lambda x: x["sent_uid"]), F.array().cast("array<bigint>")).alias("evidence")
        out.append(cut(stopped.join(lists, "query_uid", "left").select("query_uid", F.lit(hop).alias("hop"), "ev", "stop_reason", found)))
        going = active.join(stopped.select("query_uid"), "query_uid", "left_anti")
        active = cut(going.join(state.select("query_uid", "ev"), "query_uid", "left").select("query_uid", F.coalesce("ev", "before").alias("before")))
        idle = carried.join(active.select("query_uid"), "query_uid", "left_semi").join(now.select("query_uid").distinct(), "query_uid", "left_anti")
        carried = cut(evidence.join(active.select("query_uid"), "query_uid", "left_semi").unionByName(idle))
    return functools.reduce(DataFrame.unionByName, out)
