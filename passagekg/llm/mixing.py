"""Problem 8: one mixture of several sources, each with its target share of all tokens.

Copies of one text, under any doc_id and in any source, are one text: it counts once, under one of its sources (drawn
by seeded hash, scarce sources favoured, then the least doc_id), and is repeated at most as often as the strictest of
its sources allows.

The mixture is then as large as the caps of the texts so dealt allow: with w the share of a source, the size is the least of
sum(cap * tokens)/w. Every text of a source is wanted ``rate`` times or as often as its cap allows: the whole part for
sure, the rest by sampling with inclusion probability rate - floor(rate).

The sample is drawn by the cube method, balanced on tokens and on documents per source. The flight phase moves a
vector of probabilities through the null space of the two constraints until at most two texts per block are still
undecided; it runs in bounded blocks of every source, then over the undecided of many blocks, and so on (few levels:
a block of ``BLOCK`` leaves at most two). The last two per source are the landing problem: the rounding nearest to the
target is taken.

Defined results: texts without source or tokens are left out, as are sources without target; a source with a target
but without tokens reports share 0 and does not limit the others; the draw depends only on doc_id and the seed.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekg.llm.tokens import n_tokens
from passagekg.runtime import stage_table

BLOCK = 50_000
SEED = 2026
_EPS = 1e-9


def flight(tokens: list[float], pi: list[float], rng: random.Random) -> list[float]:
    """Cube flight with two balancing variables (tokens, count): all but at most two entries become 0 or 1.

    Three undecided units at a time have a null vector of the constraints in closed form; the walk along it ends
    where a unit is decided, and keeps every expected value.
    """
    pi = list(pi)
    live: list[int] = []
    for i in range(len(pi)):
        if not _EPS < pi[i] < 1 - _EPS:
            pi[i] = float(round(pi[i]))
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = (tokens[b] - tokens[c], tokens[c] - tokens[a], tokens[a] - tokens[b])
            if u == (0, 0, 0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - pi[i]) / d if d > 0 else -pi[i] / d for i, d in zip(live, u, strict=True) if d)
            down = min(pi[i] / d if d > 0 else (pi[i] - 1) / d for i, d in zip(live, u, strict=True) if d)
            step = up if rng.random() * (up + down) < down else -down
            for i, d in zip(live, u, strict=True):
                pi[i] += step * d
                if pi[i] <= _EPS or pi[i] >= 1 - _EPS:
                    pi[i] = float(round(pi[i]))
            live = [i for i in live if 0.0 < pi[i] < 1.0]
    return pi


def landing(tokens: list[float], pi: list[float]) -> list[float]:
    """Rounds the last undecided units so that their tokens come nearest to the expected."""
    want = sum(t * p for t, p in zip(tokens, pi, strict=True))
    choices = range(1 << len(pi))
    best = min(choices, key=lambda c: (abs(sum(t for i, t in enumerate(tokens) if c >> i & 1) - want), c))
    return [float(best >> i & 1) for i in range(len(pi))]


def distinct_texts(sized: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(source, doc_id, n_tokens, cap): one row per distinct text of ``sized`` (doc_id, source, text_id, n_tokens)."""
    t = _valid(targets)
    rows = sized.join(F.broadcast(t.select("source", "max_repeats")), "source").groupBy("text_id", "source")
    rows = rows.agg(F.min("doc_id").alias("doc_id"), F.min("n_tokens").alias("n_tokens"), F.min("max_repeats").alias("cap"))
    held = F.sort_array(F.collect_list(F.struct("source", "doc_id"))).alias("held")  # at most one entry per target source
    texts = stage_table(rows.groupBy("text_id").agg(held, F.min("n_tokens").alias("n_tokens"), F.min("cap").alias("cap")), "mix-copies")
    groups = texts.groupBy(F.col("held.source").alias("sources")).agg(F.sum(F.col("n_tokens") * F.col("cap")).alias("room")).collect()  # sets of target sources
    weights = claims([(r.sources, float(r.room)) for r in groups], {r.source: r.target_share for r in t.collect()})
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])

    def draw(x):
        u = (F.pmod(F.xxhash64("text_id", x["source"], F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
        return F.struct((-F.log(u) / weight[x["source"]]).alias("draw"), x["source"].alias("source"), x["doc_id"].alias("doc_id"))

    return texts.withColumn("one", F.array_min(F.transform("held", draw))).select("one.source", "one.doc_id", "n_tokens", "cap")


def claims(groups: list[tuple[list[str], float]], share: dict[str, float], rounds: int = 300) -> dict[str, float]:
    """Weight of every source in drawing texts that several sources hold, so that each has room for its share."""
    weights = {s: share[s] for s in sorted(share)}
    for _ in range(rounds):
        room = dict.fromkeys(weights, 0.0)
        for sources, n in groups:
            total = sum(weights[s] for s in sources)
            for s in sources:
                room[s] += n * weights[s] / total
        weights = {s: min(max(w * (share[s] / room[s]) ** 0.5, 1e-9), 1e9) if room[s] else w for s, w in weights.items()}
        top = max(weights.values(), default=1.0)
        weights = {s: max(w / top, 1e-9) for s, w in weights.items()}
    return weights or {"": 1.0}


def _valid(targets: DataFrame) -> DataFrame:
    t = targets.select("source", F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"))
    return t.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0")


def level(need: float, room: list[tuple[int, float]]) -> float:
    """The rate at which texts of ``room`` [(cap, tokens)], none beyond its cap, give ``need`` tokens."""
    rate = 0.0
    for cap in sorted({c for c, _ in room}):
        open_ = sum(n for c, n in room if c >= cap)
        if need <= (cap - rate) * open_:
            return rate + need / open_
        need -= (cap - rate) * open_
        rate = float(cap)
    return rate


def plan(texts: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, cap, sure, pi): one row per source and cap of its texts (at most the square of the target sources)."""
    room: dict[str, list[tuple[int, float]]] = {}
    for r in texts.groupBy("source", "cap").agg(F.sum("n_tokens").alias("n")).collect():  # bounded by the target list
        room.setdefault(r.source, []).append((r.cap, float(r.n)))
    share = {r.source: r.target_share for r in _valid(targets).collect()}
    size = min((sum(c * n for c, n in held) / share[s] for s, held in room.items()), default=0.0)
    rows = []
    for source, held in sorted(room.items()):
        rate = level(size * share[source], held)
        for cap, _ in sorted(held):
            wanted = min(rate, float(cap))
            whole = int(wanted + _EPS)
            rows.append((source, cap, whole, max(wanted - whole, 0.0)))
    return texts.sparkSession.createDataFrame(rows, "source string, cap int, sure int, pi double")


def _fly(rows: DataFrame, blocks: int, level: int, seed: int) -> DataFrame:
    """One level of flights: ``rows`` (source, doc_id, n_tokens, pi, ...), in ``blocks`` blocks per source."""
    columns = rows.columns

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id"])
        rng = random.Random(f"{seed}:{level}:{pdf['source'].iloc[0]}:{pdf['block'].iloc[0]}")
        pdf["pi"] = flight(pdf["n_tokens"].astype(float).tolist(), pdf["pi"].tolist(), rng)
        return pdf[columns]

    hashed = rows.withColumn("h", F.xxhash64("doc_id", F.lit(seed + level))).withColumn("block", F.pmod("h", F.lit(blocks)))
    return hashed.groupBy("source", "block").applyInPandas(block, rows.schema)


def sample(rows: DataFrame, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """``rows`` (source, doc_id, n_tokens, pi, ...) with every pi decided: 1 for the texts drawn, 0 for the others.

    The decision stays in the row it was made for, so nothing is joined back.
    """
    level, n = 0, rows.where("pi > 0").count()
    done, rows = rows.where("pi = 0"), rows.where("pi > 0")
    while True:
        blocks = max(1, -(-n // block))
        flown = stage_table(_fly(rows, blocks, level, seed), f"flight-{level}")
        done = done.unionByName(flown.where("pi = 0.0 OR pi = 1.0"))
        rows = flown.where("pi > 0.0 AND pi < 1.0")
        if blocks == 1:
            break
        n = rows.count()
        level += 1

    def land(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        pdf["pi"] = landing(pdf["n_tokens"].astype(float).tolist(), pdf["pi"].tolist())
        return pdf

    # at most two rows per source are left
    return done.unionByName(rows.groupBy("source").applyInPandas(land, rows.schema))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each distinct text is in the mixture (at least once)."""
    d = documents.where("source IS NOT NULL")
    sized = d.select("doc_id", "source", F.unhex(F.sha2("text", 256)).alias("text_id"), n_tokens(F.col("text")).alias("n_tokens")).where("n_tokens > 0")
    texts = stage_table(distinct_texts(sized, targets, seed), "mix-texts")
    rows = texts.join(F.broadcast(plan(texts, targets)), ["source", "cap"])  # a row per source and cap; the target list is fixed
    drawn = sample(rows.select("source", "doc_id", "n_tokens", "sure", "pi"), seed)
    return drawn.select("doc_id", "source", "n_tokens", (F.col("sure") + F.col("pi")).cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Report (source, target_share, share, tokens, n_texts, most_copies), one row per target source."""
    per = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("n_texts"), F.max("copies").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    t = targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats")
    j = t.join(per, "source", "left").crossJoin(total)  # one row
    return j.select(
        "source", "target_share", F.round(F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), "max_repeats",
    )


def kept_to(mixed: DataFrame, documents: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, near, capped) per target: whether its tokens are as near to its share as whole texts
    can be relied on to come, and no text of it, whoever holds a copy, is used more often than it allows.

    Each source is off by less than its longest text, and the total by less than one text of every source.
    """
    text = F.sha2("text", 256).alias("text_id")
    held = documents.where("source IS NOT NULL").select("doc_id", "source", text)
    used = mixed.select("doc_id", "copies").join(held.select("doc_id", "text_id"), "doc_id").groupBy("text_id").agg(F.sum("copies").alias("used"))
    t = _valid(targets)
    over = held.join(used, "text_id").join(t.select("source", "max_repeats"), "source").groupBy("source").agg(F.max(F.col("used") - F.col("max_repeats")).alias("over"))
    s = shares(mixed, targets).select("source", "target_share", "tokens", "max_repeats").join(over, "source", "left")
    whole = mixed.agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("all"), F.max("n_tokens").alias("longest"))
    room = F.col("longest") * (1 + F.col("target_share") * t.count())
    near = F.abs(F.col("tokens") - F.col("target_share") * F.col("all")) <= room
    return s.crossJoin(whole).select("source", "target_share", "max_repeats", near.alias("near"), (F.coalesce("over", F.lit(0)) <= 0).alias("capped"))  # one row
