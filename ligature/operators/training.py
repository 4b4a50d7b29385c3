"""Training of encoders and policies by data-parallel gradient steps.

Each epoch is one Spark job: weights are broadcast, every partition sums the loss and gradient of its examples, and the
sums, one number for each parameter, meet on the driver, which takes the step. Examples never leave the executors, and
random choices are hashes of (seed, epoch, example), so results don't depend on the partitioning beyond rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import encoders as E
from ..functions import gradients as G
from ..lineage import cut
from . import kernels as K
from .dealing import ROWS_A_TASK, dealt
from .matching import average_precision as ranked_precision
from .packs import CELLS, arrow_schema, by_length, numbers, places, table
from .trees import matrices, matrix


#: Examples that go through a network at once.
EXAMPLES = 1000


def summed(rows: DataFrame, work: Callable[[Iterator], tuple[float, float, np.ndarray]], arrow: bool = False) -> tuple[float, float, np.ndarray]:
    """(count, loss, gradient) summed over partitions; work takes frames, or Arrow batches."""

    def run(batches):
        n, loss, g = work(batches)
        yield pd.DataFrame({"k": np.arange(-2, len(g), dtype=np.int32), "x": np.concatenate([[n, loss], g])})

    def run_arrow(batches):
        for f in run(batches):
            yield pa.RecordBatch.from_pandas(f, arrow_schema("k int, x double"), preserve_index=False)

    sums = (rows.mapInArrow(run_arrow, "k int, x double") if arrow else rows.mapInPandas(run, "k int, x double")).groupBy("k").agg(F.sum("x").alias("x")).toArrow()
    # One row for each parameter: put in order here, as a sort would be one more job a step.
    x = sums.column(1).to_numpy()[np.argsort(sums.column(0).to_numpy())]
    return (float(x[0]), float(x[1]), x[2:]) if len(x) else (0.0, 0.0, np.zeros(0))


def metric_weights(seed: int) -> dict:
    return E.harmonic_weights(seed) | {"raw_scale": np.asarray(0.0), "bias": np.asarray(0.0)}


def metric_step(examples: DataFrame, seed: int, epoch: int, w: dict, adam: G.Adam) -> tuple[dict, float, float]:
    """(new weights, loss, weight of the examples) of one step on all examples, each rolled by a hash of the example."""
    shared = examples.sparkSession.sparkContext.broadcast(w)

    def work(batches):
        n, loss, g = 0.0, 0.0, np.zeros(sum(np.size(x) for x in shared.value.values()))
        for f in batches:
            at = (np.arange(12)[None, :] - numbers(f["shift"])[:, None]) % 12
            left, right = (np.take_along_axis(table(f[c]), at, 1) for c in ("left", "right"))
            label, weight = (numbers(f[c]).astype(float) for c in ("label", "weight"))
            # Of so many examples that the layers stay in a core's cache.
            for k in range(0, len(label), EXAMPLES):
                part = slice(k, k + EXAMPLES)
                one, d = G.pair_loss(left[part], right[part], label[part], weight[part], shared.value)
                n, loss, g = n + float(weight[part].sum()), loss + one, g + G.flat(d)
        return n, loss, g

    rows = examples.select("left", "right", "label", "weight", F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "id"), F.lit(12)).cast("int").alias("shift"))
    n, loss, g = summed(rows, work, arrow=True)
    return (adam.step(w, G.shaped(g / n, w)) if n > 0 else w), loss, n


def train_metric(examples: DataFrame, seed: int = 0, epochs: int = 20, rate: float = 1e-2, decay: float = 1e-4) -> tuple[dict, list[float]]:
    """Weights of the harmonic pair model and the mean loss of each epoch, of one step on all examples.

    Examples are rows (id, left, right, label, weight); in each epoch both vectors are rolled by a hash of the example.
    """
    w, adam, losses = metric_weights(seed), G.Adam(rate, decay), []
    for epoch in range(epochs):
        w, loss, n = metric_step(examples, seed, epoch, w, adam)
        losses.append(loss / max(n, 1e-12))
    return w, losses


def pair_logits(examples: DataFrame, w: dict) -> DataFrame:
    """examples with `score`, the logit of a boundary between left and right."""
    shared = examples.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("double")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        now = shared.value
        a, b = (E.harmonic(np.array(x.tolist(), float), now) for x in (left, right))
        return pd.Series(np.logaddexp(0, now["raw_scale"]) * np.linalg.norm(a - b, axis=1) + now["bias"])

    return examples.withColumn("score", run("left", "right"))


def metric_validation(examples: DataFrame, w: dict) -> float:
    """The mean over works of the average precision of the model's logits; examples: (id, work, left, right, label)."""
    rows = pair_logits(examples, w).select("work", "score", (F.col("label") == 1).alias("positive"), F.col("id").alias("at"))
    return float(ranked_precision(rows, "work").agg(F.avg("ap")).first()[0] or 0.0)


def work_weights(examples: DataFrame) -> DataFrame:
    """examples with `weight`: equal for all works together, with mean one."""
    sizes = examples.groupBy("work").agg(F.count("*").alias("_n"))
    whole = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_works"), F.lit(1).alias("_one"))
    weights = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(whole), "_one").select("work", (F.col("_all") / (F.col("_n") * F.col("_works"))).alias("weight"))
    return examples.drop("weight").join(weights, "work")


def kept_once(rows: DataFrame) -> DataFrame:
    """rows (id, ...) written once, dealt to tasks and cached, so that a step neither finds them anew nor carries the plan that led to them.

    There are as many tasks as cores, fewer if one would have less than EXAMPLES, more if it would have over ROWS_A_TASK.
    """
    told = cut(rows)
    n = told.count()
    tasks = max(1, min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // EXAMPLES)), -(-n // ROWS_A_TASK))
    return told.repartition(tasks, "id").cache()


def fit_metric(examples: DataFrame, validation: DataFrame, seed: int = 0, epochs: int = 150, steps: int = 8, rate: float = 1e-3, decay: float = 1e-4, patience: int = 20) -> tuple[dict, list[tuple[int, float, float]]]:
    """Weights of the best epoch by validation, and rows (epoch, mean loss, validation score).

    Each epoch takes `steps` steps; a hash of (seed, epoch, id) deals each example to one of them, so batches don't
    depend on partitions and each example counts once an epoch. Training stops after `patience` epochs without a better
    score. Both tables are rows (id, work, left, right, label), written once and read for each step or epoch.
    """
    w, adam, history = metric_weights(seed), G.Adam(rate, decay), []
    kept, best, stale = w, -np.inf, 0
    rows, validation = (kept_once(x) for x in (work_weights(examples), validation))
    for epoch in range(1, epochs + 1):
        losses = []
        for step in range(steps):
            batch = rows.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), F.lit("step"), "id"), F.lit(steps)) == step)
            w, loss, n = metric_step(batch, seed, epoch, w, adam)
            if n:
                losses.append(loss / n)
        score = metric_validation(validation, w)
        history.append((epoch, float(np.mean(losses)) if losses else 0.0, score))
        stale += 1
        if score > best + 1e-8:
            kept, best, stale = w, score, 0
        if stale >= patience:
            break
    for x in (rows, validation):
        x.unpersist()
    return kept, history


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def imitation(vectors: np.ndarray, marks: set[int], encoder: dict, policy: dict) -> tuple[float, dict]:
    """Mean loss and gradient of one episode that follows the teacher.

    The teacher's merges make spans of the exact affinity tree and cross no mark, if there are such; of those the
    nearest pair is taken.
    """
    reps = E.harmonic(vectors, encoder)
    spans = {(i, j) for i, j, _ in K.affinity_program(matrix(reps, "plain"))[0]}
    clusters, loss, g, n = [(i, i + 1) for i in range(len(vectors))], 0.0, None, 0
    while len(clusters) > 1:
        x = E.candidates(vectors, clusters, encoder)
        p = softmax(E.policy(x, policy))
        near = np.linalg.norm(x[:, 2 * E.PAIRS : 3 * E.PAIRS], axis=1)
        pairs = list(zip(clusters, clusters[1:], strict=False))
        safe = [k for k, ((i, _), (_, j)) in enumerate(pairs) if not any(i < m < j for m in marks)]
        taught = [k for k, ((i, _), (_, j)) in enumerate(pairs) if (i, j) in spans]
        pool = [k for k in taught if k in safe] or safe or taught or list(range(len(pairs)))
        at = min(pool, key=lambda k: (near[k], k))
        loss -= float(np.log(max(p[at], 1e-12)))
        out = p.copy()
        out[at] -= 1
        d = G.policy_back(x, policy, out)
        g = d if g is None else {k: g[k] + d[k] for k in g}
        n += 1
        clusters[at : at + 2] = [(clusters[at][0], clusters[at + 1][1])]
    return (loss / n, {k: v / n for k, v in g.items()}) if n else (0.0, {k: np.zeros_like(v) for k, v in policy.items()})


def imitations(vectors: np.ndarray, marks: np.ndarray, encoder: dict, policy: dict) -> tuple[float, np.ndarray]:
    """The sums of imitation's losses and flat gradients over pieces of one length; marks: [piece, place] for places 0..n."""
    n = vectors.shape[1]
    reps = E.harmonic(vectors.reshape(-1, vectors.shape[2]), encoder).reshape(len(vectors), n, -1)
    tree, upto = K.spans(K.affinity_cuts(matrices(reps, "plain"))[0]), marks.cumsum(axis=1)
    episodes, loss, g = E.Episodes(vectors, encoder), 0.0, np.zeros(sum(np.size(x) for x in policy.values()))
    row = episodes.row
    for m in range(n - 1, 0, -1):
        x = episodes.features()
        flat = x.reshape(len(row) * m, -1)
        p = E.shares(E.policy(flat, policy).reshape(-1, m))
        near = np.linalg.norm(x[:, :, 2 * E.PAIRS : 3 * E.PAIRS], axis=2)
        i, j = episodes.edges[:, :-2], episodes.edges[:, 2:]
        safe = upto[row[:, None], j - 1] == upto[row[:, None], i]
        taught = tree[row[:, None], i, j]
        pool = np.where((taught & safe).any(axis=1)[:, None], taught & safe, np.where(safe.any(axis=1)[:, None], safe, np.where(taught.any(axis=1)[:, None], taught, True)))
        at = np.where(pool, near, np.inf).argmin(axis=1)
        loss -= float(np.log(np.maximum(p[row, at], 1e-12)).sum()) / (n - 1)
        p[row, at] -= 1
        g += G.flat(G.policy_back(flat, policy, p.ravel())) / (n - 1)
        episodes.merge(at)
    return loss, g


def average_precisions(nodes: np.ndarray, edges: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """average_precision of each of many pieces of one length; nodes: [piece, merge, 3], marks: [piece, place] for places 0..n."""
    row, m = np.arange(len(nodes))[:, None], np.arange(nodes.shape[1])
    span = edges[row, nodes[:, :, 1]] - edges[row, nodes[:, :, 0]]
    order = np.lexsort((np.broadcast_to(-m, span.shape), -span), axis=1)
    hit = marks[row, nodes[row, order, 2]]
    hits = hit.cumsum(axis=1)
    total = (hit * hits / (m + 1)).sum(axis=1)
    return np.divide(total, hit.sum(axis=1), out=np.zeros(len(nodes)), where=hit.any(axis=1))


def reinforcements(vectors: np.ndarray, edges: np.ndarray, marks: np.ndarray, encoder: dict, policy: dict, chance: np.ndarray, entropy: float) -> tuple[float, np.ndarray]:
    """The sums of reinforce's losses and flat gradients over pieces of one length; chance: a number in [0, 1) for each piece and merge."""
    n = vectors.shape[1]
    base = average_precisions(E.rollouts(vectors, encoder, policy)[0], edges, marks)
    episodes, steps = E.Episodes(vectors, encoder), []
    row = episodes.row
    for m in range(n - 1, 0, -1):
        x = episodes.features().reshape(len(row) * m, -1)
        p = E.shares(E.policy(x, policy).reshape(-1, m))
        upto = p.cumsum(axis=1)
        at = (upto / upto[:, -1:] <= chance[:, n - 1 - m, None]).sum(axis=1)
        steps.append((x, p, at))
        episodes.merge(at)
    gain = average_precisions(episodes.merges(), edges, marks) - base
    loss, g = 0.0, np.zeros(sum(np.size(x) for x in policy.values()))
    for x, p, at in steps:
        logs = np.log(np.maximum(p, 1e-12))
        own = -(p * logs).sum(axis=1)
        loss += float((-gain * logs[row, at] - entropy * own / len(steps)).sum())
        apart = p.copy()
        apart[row, at] -= 1
        out = gain[:, None] * apart + entropy / len(steps) * p * (logs + own[:, None])
        g += G.flat(G.policy_back(x, policy, out.ravel()))
    return loss, g


def average_precision(nodes: list[K.Node], edges: np.ndarray, marks: set[int]) -> float:
    """Average precision of splits by the time that their node spans, later merges first on ties."""
    ranked = sorted(((edges[j] - edges[i], m, k) for m, (i, j, k) in enumerate(nodes)), key=lambda t: (-t[0], -t[1]))
    hits, total = 0, 0.0
    for rank, (_, _, k) in enumerate(ranked, 1):
        if k in marks:
            hits += 1
            total += hits / rank
    return total / hits if hits else 0.0


def reinforce(vectors: np.ndarray, edges: np.ndarray, marks: set[int], encoder: dict, policy: dict, rng: np.random.Generator, entropy: float) -> tuple[float, float, dict]:
    """(reward, loss, gradient in the policy) of one sampled episode against the likeliest one."""
    reward, _, loss, g, _ = episode(vectors, edges, marks, encoder, policy, rng, entropy, joint=False)
    return reward, loss, g


def episode(vectors: np.ndarray, edges: np.ndarray, marks: set[int], encoder: dict, policy: dict, rng: np.random.Generator, entropy: float, joint: bool) -> tuple[float, float, float, dict, dict]:
    """(reward, baseline, loss, gradient in the policy, gradient in the encoder) of one sampled episode.

    The loss is the log probability of the merges times how far the reward falls short of the likeliest episode's, less
    the mean entropy of the steps. If joint, it is followed through the merged vectors into the encoder too; else that
    gradient is empty.
    """
    base = average_precision(E.rollout(vectors, encoder, policy)[0], edges, marks)
    clusters, steps, nodes = [(i, i + 1) for i in range(len(vectors))], [], []
    while len(clusters) > 1:
        x = E.candidates(vectors, clusters, encoder)
        p = softmax(E.policy(x, policy))
        at = int(rng.choice(len(p), p=p))
        steps.append((list(clusters), x, p, at))
        (i, k), (_, j) = clusters[at], clusters[at + 1]
        nodes.append((i, j, k))
        clusters[at : at + 2] = [(i, j)]
    reward = average_precision(nodes, edges, marks)
    g, loss = {k: np.zeros_like(v) for k, v in policy.items()}, 0.0
    deep = {k: np.zeros_like(v) for k, v in encoder.items()} if joint else {}
    for then, x, p, at in steps:
        logs = np.log(np.maximum(p, 1e-12))
        own = -(p * logs).sum()
        loss += -(reward - base) * logs[at] - entropy * own / len(steps)
        out = (reward - base) * (p - (np.arange(len(p)) == at)) + entropy / len(steps) * p * (logs + own)
        d = G.policy_back(x, policy, out)
        g = {k: g[k] + d[k] for k in g}
        if joint:
            d = G.candidates_back(vectors, then, encoder, G.policy_input_back(x, policy, out))
            deep = {k: deep[k] + d[k] for k in deep}
    return reward, base, loss, g, deep


def policy_score(pieces: DataFrame, encoder: dict, policy: dict) -> float:
    """The mean over works of the mean average precision of the likeliest episodes; pieces: (work, piece, leaves, marks)."""
    shared = pieces.sparkSession.sparkContext.broadcast((encoder, policy))

    def run(batches):
        for f in batches:
            works = f["work"].to_pylist()
            for rows, vectors, edges in by_length(f["leaves"], CELLS // 16):
                marks = places(f["marks"].take(pa.array(rows)), edges.shape[1])
                ap = average_precisions(E.rollouts(vectors, *shared.value)[0], edges, marks)
                yield pa.RecordBatch.from_arrays([pa.array([works[k] for k in rows], pa.string()), pa.array(ap)], names=["work", "ap"])

    found = pieces.select("work", "leaves", "marks").mapInArrow(run, "work string, ap double")
    return float(found.groupBy("work").agg(F.avg("ap").alias("ap")).agg(F.avg("ap")).first()[0] or 0.0)


def train_jointly(pieces: DataFrame, validation: DataFrame, encoder: dict, policy: dict, joint: bool = True, seed: int = 0, epochs: int = 100, rate: float = 1e-3, encoder_rate: float = 1e-4, entropy: float = 0.01, every: int = 5, patience: int = 20) -> tuple[dict, dict, list[dict]]:
    """(encoder, policy, history) after reinforcement of the policy alone, or of both.

    Both tables are rows (work, piece, leaves, marks). Each epoch takes one piece of each work, by a hash of (seed, epoch,
    work), and one step on their mean gradient, cut to a norm of 5 for each network. Every so many epochs and at the
    end the likeliest episodes of the validation pieces are scored; the best scored weights are returned, and training
    stops after `patience` epochs without a better score. History rows have epoch, loss, reward, baseline, validation.
    """
    order = Window.partitionBy("work").orderBy("piece")
    numbered = pieces.select("work", "piece", "leaves", "marks", (F.row_number().over(order) - 1).alias("_k"), F.count("*").over(Window.partitionBy("work")).alias("_n"))
    numbered = dealt(numbered, "piece").cache()
    adams, history = (G.Adam(rate), G.Adam(encoder_rate)), []
    kept, best, stale = (encoder, policy), -np.inf, 0
    for epoch in range(1, epochs + 1):
        shared = pieces.sparkSession.sparkContext.broadcast((encoder, policy))

        def work(batches, shared=shared, epoch=epoch):
            enc, pol = shared.value
            sizes = [sum(np.size(x) for x in w.values()) for w in (pol, enc)]
            n, loss, g = 0.0, 0.0, np.zeros(2 + sizes[0] + (sizes[1] if joint else 0))
            for f in batches:
                for piece, items, marks in zip(f["piece"], f["leaves"], f["marks"], strict=True):
                    key = hashlib.sha256(f"{seed}|{epoch}|{piece}".encode()).digest()[:8]
                    vectors, edges = np.array([list(x["vec"]) for x in items]), np.array([x["start"] for x in items] + [items[-1]["end"]])
                    found = set() if marks is None else {int(m) for m in marks}
                    reward, base, one, d, deep = episode(vectors, edges, found, enc, pol, np.random.default_rng(int.from_bytes(key, "little")), entropy, joint)
                    n, loss = n + 1, loss + one
                    g += np.concatenate([[reward, base], G.flat(d), *([G.flat(deep)] if joint else [])])
            return n, loss, g

        chosen = numbered.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(epoch), "work"), F.col("_n")) == F.col("_k")).select("piece", "leaves", "marks")
        n, loss, g = summed(chosen, work)
        if not n:
            break
        size = sum(np.size(x) for x in policy.values())
        mean = g[2:] / n
        now = adams[0].step(policy, G.shaped(mean[:size], policy), most=5.0)
        if joint:
            encoder = adams[1].step(encoder, G.shaped(mean[size:], encoder), most=5.0)
        policy, score = now, None
        if epoch % every == 0 or epoch == epochs:
            score = policy_score(validation, encoder, policy)
            stale += every
            if score > best + 1e-8:
                kept, best, stale = (encoder, policy), score, 0
        history.append({"epoch": epoch, "loss": loss / n, "reward": float(g[0] / n), "baseline": float(g[1] / n), "validation": score})
        if stale >= patience:
            break
    numbered.unpersist()
    return *kept, history


def train_policy(pieces: DataFrame, encoder: dict, seed: int = 0, epochs: int = 10, rate: float = 1e-3, start: dict | None = None, entropy: float = 0.01) -> tuple[dict, list[float]]:
    """Policy weights and the mean loss of each epoch: by imitation, or from `start` by reinforcement.

    Pieces are rows (piece, leaves array<struct<leaf,start,end,vec>>, marks array<int>), marks being splits.
    """
    w, adam, losses = start or E.policy_weights(seed), G.Adam(rate), []
    for epoch in range(epochs):
        shared = pieces.sparkSession.sparkContext.broadcast((w, encoder))

        def work(batches, shared=shared, epoch=epoch):
            policy, enc = shared.value
            n, loss, g = 0.0, 0.0, np.zeros(sum(np.size(x) for x in policy.values()))
            for f in batches:
                names = f["piece"].to_pylist()
                for rows, vectors, edges in by_length(f["leaves"], CELLS // 16):
                    marks = places(f["marks"].take(pa.array(rows)), edges.shape[1])
                    if start is None:
                        one, d = imitations(vectors, marks, enc, policy)
                    else:
                        keys = [hashlib.sha256(f"{seed}|{epoch}|{names[k]}".encode()).digest()[:8] for k in rows]
                        chance = np.stack([np.random.default_rng(int.from_bytes(k, "little")).random(vectors.shape[1] - 1) for k in keys])
                        one, d = reinforcements(vectors, edges, marks, enc, policy, chance, entropy)
                    n, loss, g = n + len(rows), loss + one, g + d
            return n, loss, g

        n, loss, g = summed(pieces.select("piece", "leaves", "marks"), work, arrow=True)
        losses.append(loss / max(n, 1.0))
        w = adam.step(w, G.shaped(g / max(n, 1.0), w), most=5.0)
    return w, losses
