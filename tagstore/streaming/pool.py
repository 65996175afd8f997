"""The pool that decorrelates accesses: arriving queries wait in it, and each round serves one of them or a substitute."""

import hashlib
import json

import pandas as pd
from pyspark.sql import DataFrame, functions as F

POLICIES = {"uniform": lambda w: w, "linear": lambda w: w + 3, "exponential": lambda w: w * 5}


def draw(seed, group, number) -> float:
    """A number in [0, 1) by md5, the same at every rerun."""
    return int(hashlib.md5(f"{seed}:{group}:{number}".encode()).hexdigest()[:8], 16) / 2**32


def rounds(state: dict, group, keys, theta: int, policy: str, seed: int):
    """One round for each arriving key: it joins the pool; above theta a member drawn by weight is served, else nothing real.

    `state` holds pool (pairs of key and weight) and round; it is changed in place. Yields (round, served or None, pool size).
    Weights that grow beyond 1e100 are divided by the greatest.
    """
    grow = POLICIES[policy]
    for key in keys:
        state["pool"].append([key, 1.0])
        served, number = None, state["round"]
        if len(state["pool"]) > theta:
            left = draw(seed, group, number) * sum(w for _, w in state["pool"])
            at = 0
            while at < len(state["pool"]) - 1 and left >= state["pool"][at][1]:
                left -= state["pool"][at][1]
                at += 1
            served = state["pool"].pop(at)[0]
            state["pool"] = [[k, grow(w)] for k, w in state["pool"]]
            top = max((w for _, w in state["pool"]), default=1.0)
            if top > 1e100:
                state["pool"] = [[k, w / top] for k, w in state["pool"]]
        state["round"] = number + 1
        yield number, served, len(state["pool"])


def pooled(trace: DataFrame, group: str, seq: str, key: str, theta: int, policy="uniform", seed=17) -> DataFrame:
    """The pool over a whole table, each group (a client) in order of seq. Null keys are left out; a group's trace fits in a task."""

    def one(pdf):
        pdf = pdf.sort_values("seq", kind="stable")
        state, g = {"pool": [], "round": 0}, pdf["grp"].iloc[0]
        out = [(g, r, k, n) for r, k, n in rounds(state, g, pdf["key"].tolist(), theta, policy, seed)]
        return pd.DataFrame(out, columns=["grp", "round", "served", "waiting"])

    rows = trace.select(F.col(group).alias("grp"), F.col(seq).alias("seq"), F.col(key).cast("string").alias("key")).dropna()
    return rows.groupBy("grp").applyInPandas(one, f"grp {dict(rows.dtypes)['grp']}, round long, served string, waiting long")


def pooled_stream(stream: DataFrame, group: str, seq: str, key: str, theta: int, policy="uniform", seed=17) -> DataFrame:
    """The same pool over a stream, its state kept by group between micro-batches; arrivals of a micro-batch go in order of seq."""
    rows = stream.select(F.col(group).alias("grp"), F.col(seq).alias("seq"), F.col(key).cast("string").alias("key")).dropna()

    def some(keys, frames, kept):
        state = {"pool": json.loads(kept.get[0]), "round": kept.get[1]} if kept.exists else {"pool": [], "round": 0}
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = [(keys[0], r, k, n) for r, k, n in rounds(state, keys[0], pdf["key"].tolist(), theta, policy, seed)]
        kept.update((json.dumps(state["pool"]), state["round"]))
        yield pd.DataFrame(out, columns=["grp", "round", "served", "waiting"])

    kind = dict(rows.dtypes)["grp"]
    return rows.groupBy("grp").applyInPandasWithState(some, f"grp {kind}, round long, served string, waiting long", "pool string, round long", "append", "NoTimeout")
