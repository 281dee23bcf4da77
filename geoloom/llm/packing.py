"""Best-fit packing of token sequences by a configuration linear program.

A configuration is a multiset of piece lengths that fit into one sequence. The LP picks how often to
use each so that all pieces are covered by as few sequences as possible. Only the histogram of
lengths (at most as many entries as a sequence has tokens) enters it, whatever the corpus' size.
Multiplicative weights approximate it: lengths that are covered less weigh more, and a knapsack
dynamic program prices the best configurations under the weights; they may leave waste. The
fractional solution is rounded down, the rest solved again, and what rounding leaves is placed best
fit first. Pieces then find their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.llm.kernels import text_arrays
from geoloom.session import materialize, ship_package

#: Rounds at most, how much of a length a round covers, how sharply weights fall with coverage.
ROUNDS, STEP, ETA = 600, 0.05, 2.0
#: Rounds of the quick solution, which is solved again for what it leaves, and how much of a length a round covers.
FILL_ROUNDS, FILL_STEP = 150, 0.5
#: How far below the best value a configuration may be, how far above the bound a solution, how often what is left is solved.
SLACK, GAP, AGAIN = 0.003, 0.001, 4
#: (index of a length, pieces of it), by index.
Config = tuple[tuple[int, int], ...]
#: Characters of white space in a row from which on a text goes through `tokenizers`.
LONG_SPACE = 1000
_encoders: dict = {}


def _encoder(path: str):
    """text -> ids of the byte-level BPE file at path, as `tokenizers` gives them; kept while the worker lives.

    Most texts go through tiktoken, which runs the same merges several times faster; ranks and
    pattern come from the file, and the tests hold both against each other. Texts that it can't do
    alike go through `tokenizers` itself: those with the special token's string, which is a token of
    its own there, and those on which tiktoken's pattern gives up (very long runs of white space).
    """
    if path not in _encoders:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        special = [t["content"] for t in whole.get("added_tokens", [])]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in token): k for token, k in whole["model"]["vocab"].items() if all(c in byte for c in token) and token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the byte-level pre-tokeniser's pattern
        fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)
        long_space = re.compile(r"\s{%d}" % LONG_SPACE)

        def encode(text: str) -> list[int]:
            if any(x in text for x in special) or long_space.search(text):
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path] = encode
    return _encoders[path]


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        encode = _encoder(path)
        for batch in batches:
            data, starts, ends, _ = text_arrays(batch.column(1))
            row, piece, start, length, crc, rank = [], [], [], [], [], []
            for d, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                ids = np.array([*encode(data[a:b].tobytes().decode()), end_id], "<u4")
                head = (len(ids) - 1) % capacity + 1
                for k, s in enumerate([0, *range(head, len(ids), capacity)]):
                    e = head if k == 0 else s + capacity
                    row.append(d)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(ids[s:e].tobytes()))
                    rank.append(ranks[e - s])
                    ranks[e - s] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                ["id", "piece", "start", "length", "ids_crc32", "part", "rank"],
            )

    return run


def price(values: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(largest value of a configuration of at most c tokens, a length it has or -1 if c - 1 does as well) for each c.

    Knapsack by dynamic programming, any number of each length; lengths ascend.
    """
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, "right"))
        with_it = best[c - lengths[:k]] + values[:k]
        j = int(with_it.argmax())
        best[c] = best[c - 1]
        if with_it[j] > best[c] + 1e-12:
            best[c], last[c] = with_it[j], j
    return best, last


def _configs(values: np.ndarray, lengths: np.ndarray, capacity: int, order: np.ndarray):
    """(best value of a configuration, an iterator over one configuration for each length of which any is within SLACK of it)."""
    best, last = price(values, lengths, capacity)
    chosen, size = last.tolist(), lengths.tolist()
    down = np.maximum.accumulate(np.where(last >= 0, np.arange(capacity + 1), 0)).tolist()
    near = (values > 0) & (values + best[capacity - lengths] >= (1 - SLACK) * best[capacity])

    def made():
        for k in order[near[order]].tolist():
            config, c = Counter([k]), down[capacity - size[k]]
            while c > 0:
                config[chosen[c]] += 1
                c = down[c - size[chosen[c]]]
            key = tuple(sorted(config.items()))
            yield key, [j for j, _ in key], np.array([m for _, m in key], float)

    return float(best[capacity]), made()


def fill(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = FILL_ROUNDS) -> tuple[dict[Config, float], float]:
    """(x of each configuration, lower bound) of the LP min sum x_c with sum_c a_cl x_c >= n_l, with no length covered beyond n_l.

    As cover(), but a length that is covered is worth nothing any more, so that few rounds do. What
    stays uncovered when configurations run out, if anything, is left to others.
    """
    n, covered = counts.astype(float), np.zeros(len(counts))
    bound, x = float((n * lengths).sum()) / capacity, {}
    for _ in range(rounds):
        open_ = covered < 1 - 1e-9
        if not open_.any():
            break
        # Of nearly equal values the lengths with most pieces left are taken, or scarce ones would end every configuration's rise.
        rest = n * (1 - covered)
        values = np.where(open_, lengths * np.exp(-ETA * (covered - covered[open_].min())) * (1 + SLACK / 2 * rest / rest.max()), 0.0)
        best, made = _configs(values, lengths, capacity, np.argsort(covered, kind="stable"))
        bound = max(bound, float((n * values).sum()) / best)
        gone = np.zeros(len(n))
        for key, rows, a in made:
            step = float((np.minimum(FILL_STEP - gone[rows], 1 - covered[rows] - gone[rows]) * n[rows] / a).min())
            if step > 1e-9:
                gone[rows] += step * a / n[rows]
                x[key] = x.get(key, 0.0) + step
        covered += gone
    return x, bound


def cover(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[dict[Config, float], float]:
    """(x of each configuration, lower bound) of the LP min sum x_c with sum_c a_cl x_c >= n_l for each length l.

    Multiplicative weights: a piece is worth its length, which is its dual price where packings without
    waste exist, times a weight that falls exponentially with its length's coverage. A round prices
    the best configuration with the knapsack and raises x of those within SLACK of it, at most one
    for each length, until it has covered STEP of a length. The bound is what the values, scaled so that no
    configuration is worth more than 1, give all pieces. x is scaled to cover all and is the best
    of growing windows of rounds, as early rounds know no good weights yet; it is within GAP of the bound
    or what the rounds reached.
    """
    n = counts.astype(float)
    covered, since = np.zeros(len(n)), np.zeros(len(n))
    bound, least, found, x, reset = float((n * lengths).sum()) / capacity, np.inf, {}, {}, 16
    for r in range(rounds):
        values = lengths * np.exp(-ETA * (covered - covered.min()))
        best, made = _configs(values, lengths, capacity, np.argsort(covered, kind="stable"))
        bound = max(bound, float((n * values).sum()) / best)
        if since.min() > 0 and sum(x.values()) / since.min() < least:
            least = sum(x.values()) / since.min()
            found = {key: v / since.min() for key, v in x.items()}
        if least <= bound * (1 + GAP):
            break
        if r == reset:
            x, since, reset = {}, np.zeros(len(n)), reset * 3 // 2
        gone = np.zeros(len(n))
        for key, rows, a in made:
            step = float(((STEP - gone[rows]) * n[rows] / a).min())
            if step > 1e-9:
                gone[rows] += step * a / n[rows]
                x[key] = x.get(key, 0.0) + step
        covered += gone
        since += gone
    return found, bound


def round_down(x: dict[Config, float], rest: np.ndarray) -> list[tuple[Config, int]]:
    """Whole sequences of x, taken from rest: each x rounded down, then one wherever the fractions, in the order of configurations, add up to one.

    No configuration is used oftener than the pieces that are left allow.
    """
    plan: Counter = Counter()

    def take(key, times):
        times = min([times, *(int(rest[j]) // m for j, m in key)])
        for j, m in key:
            rest[j] -= times * m
        plan[key] += times

    for key, v in sorted(x.items(), key=lambda kv: (-kv[1], kv[0])):
        take(key, int(v + 1e-6))
    carry = 0.0
    for key, v in sorted(x.items()):
        carry += max(0.0, v - int(v + 1e-6))
        if carry >= 1 - 1e-6:
            take(key, 1)
            carry -= 1
    return [(key, times) for key, times in plan.items() if times]


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """Configurations (pieces of each length) and how often to use each; they take up all pieces exactly.

    A fractional covering solution is rounded down, the program is solved again for the pieces that
    are left, AGAIN times at most, and best fit places what rounding leaves. Of the plans after
    0, 1, ... solutions the one with the fewest sequences is returned, so none is worse than best
    fit alone. The quick solution fill() comes first, then cover(), whose weights go on until they
    fit; a plan within GAP of the bound ends it. Pieces of full length need no program.
    """
    whole = lengths == capacity
    start = [(whole.astype(np.int64), int(counts[whole][0]))] if whole.any() else []
    size = lambda p: sum(times for _, times in p) - sum(times for _, times in start)
    plans, bound = [], 0.0
    for program, most in ((fill, FILL_ROUNDS), (cover, rounds)):
        plan, rest = list(start), np.where(whole, 0, counts).astype(np.int64)
        plans.append(plan + _best_fit(lengths, rest, capacity))
        for k in range(AGAIN):
            open_ = np.flatnonzero(rest > 0)
            if not len(open_):
                break
            left = rest[open_]
            x, least = program(lengths[open_], left, capacity, most)
            bound = max(bound, least if k == 0 else 0.0)
            used = round_down(x, left)
            if not used:
                break
            rest[open_] = left
            for key, times in used:
                config = np.zeros(len(lengths), np.int64)
                for j, m in key:
                    config[open_[j]] = m
                plan.append((config, times))
            plans.append(plan + _best_fit(lengths, rest, capacity))
            if size(min(plans, key=size)) <= np.ceil(bound * (1 + GAP) - 1e-6):
                return min(plans, key=size)
    return min(plans, key=size)


def _best_fit(lengths: np.ndarray, rest: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Best fit decreasing on counts: equal bins are handled together, so work follows the distinct lengths, not the pieces."""
    room: dict[int, Counter] = {}  # space left -> bins by contents
    for k in np.argsort(-lengths):
        n, size = int(rest[k]), int(lengths[k])
        while n:
            fit = [r for r in room if r >= size]
            if fit:
                r = min(fit)
                content, have = next(iter(room[r].items()))
                each = r // size
                bins = min(have, max(1, n // each))
                each = min(each, n)
            else:
                r, content, each = capacity, (), min(capacity // size, n)
                bins = max(1, n // each)
                have = None
            if have is not None:
                if have == bins:
                    del room[r][content]
                    if not room[r]:
                        del room[r]
                else:
                    room[r][content] -= bins
            n -= bins * each
            room.setdefault(r - each * size, Counter())[(*content, (int(k), each))] += bins
    out = []
    for bins in room.values():
        for content, times in bins.items():
            config = np.zeros(len(lengths), np.int64)
            for k, m in content:
                config[k] += m
            out.append((config, times))
    return out


def plan_rows(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces per sequence, first offset) of each configuration's slots."""
    out, at, base = [], np.zeros(len(lengths), np.int64), 0
    for config, times in plan:
        offset = 0
        for k in np.flatnonzero(config):
            m = int(config[k])
            out.append((int(lengths[k]), int(at[k]), int(at[k]) + m * times, base, m, offset))
            at[k] += m * times
            offset += m * int(lengths[k])
        base += times
    return out


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its tokens and end_id; only one longer than capacity is cut, its first piece
    taking what the others, all full, leave. A null or empty text is the end id alone. Rows are
    packed one by one, so repeated rows and null ids stay; other columns are not looked at; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Written once: a piece's rank within its task and length must not change when a task runs again.
    cut = materialize(rows.mapInArrow(_cut(tokenizer_path, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long, part int, rank long"), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.withColumn("shift", before).select("length", "part", "shift")
    histogram = counts.groupBy("length").agg(F.sum("n").alias("n")).orderBy("length").collect()  # at most capacity rows
    lengths, totals = np.array([r[0] for r in histogram], np.int64), np.array([r[1] for r in histogram], np.int64)
    slots = plan_rows(lengths, solve(lengths, totals, capacity)) if len(lengths) else []
    schema = "length long, lo long, hi long, base long, per long, at long"
    plan = spark.createDataFrame(slots, schema)  # rounds and lengths bound the configurations; equi-joined by length, broadcast only if Spark finds it small
    ranked = cut.join(shifts, ["length", "part"]).withColumn("place", F.col("rank") + F.col("shift"))
    out = ranked.join(plan, (ranked.length == plan.length) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi")))
    k = F.col("place") - F.col("lo")
    return out.select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        ranked.length.alias("length"),
        "ids_crc32",
        (F.col("base") + F.floor(k / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (k % F.col("per")) * ranked.length).cast("long").alias("offset"),
    )
