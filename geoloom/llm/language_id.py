"""Language identification by a linear-chain conditional random field over words.

Each word has features from its bytes: n-grams padded at the word's ends, prefix and suffix
(affixes) and the whole word (lexicon), all hashed into fixed tables. Labels are languages;
transitions between them are learned from code-switched sequences made of stretches of training
documents. Forward-backward gives each word's label probabilities; a document's language is the one
with the most expected words, its score that share.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.llm.kernels import U64, Words, joined, mix, pieces, release, text_arrays
from geoloom.session import ship_package

#: The classifier is fitted on at most so many training documents of each language, whole texts.
TRAIN_DOCS = 200
#: Words of a block: long texts are cut into blocks that are worked off side by side.
BLOCK_WORDS = 512
SEQUENCE_WORDS, EPOCHS, BATCH = 32, 6, 128
GRAM_BITS, WORD_BITS = 16, 16
#: Text of which emissions are worked out, and labels found, at a time: a worker holds some twenty times the larger.
PIECE_BYTES = 512 << 10
HELD_BYTES = 2 << 20
LABEL, SCORE = "_geoloom_lang", "_geoloom_score"

_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = _LETTERS[0x41:0x5B] = _LETTERS[0x80:] = True


def _features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram slots of all bytes of words, first byte of each word among them, affix and lexicon slots by word)."""
    lens = w.ends - w.starts
    at = np.cumsum(lens) - lens
    total = int(lens.sum())
    src = np.arange(total, dtype=np.int64) + np.repeat(w.starts - at, lens)
    mid = w.buf[src].astype(np.uint32)
    before, after = np.empty(total, np.uint32), np.empty(total, np.uint32)
    before[1:], after[:-1] = mid[:-1], mid[1:]
    before[at], after[at + lens - 1] = 0x20, 0x20
    gram = ((before * np.uint32(0x9E3779B1) ^ mid * np.uint32(0x85EBCA77) ^ after * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - GRAM_BITS)
    word = w.hashes()
    three = np.minimum(lens, 3)
    prefix = mid[at] | (mid[at + np.minimum(1, three - 1)] << np.uint32(8)) | (mid[at + three - 1] << np.uint32(16))
    end = at + lens - 1
    suffix = mid[end] | (mid[end - np.minimum(1, three - 1)] << np.uint32(8)) | (mid[end - three + 1] << np.uint32(16))
    slots = np.stack([mix(prefix.astype(U64) + U64(1 << 32)), mix(suffix.astype(U64) + U64(2 << 32)), word]) >> U64(64 - WORD_BITS)
    return gram.astype(np.int64), at, slots.astype(np.int64)


class Model:
    """labels, the weights of n-grams and of affixes and lexicon, and the transition scores."""

    def __init__(self, labels: list[str]):
        n = len(labels)
        self.labels = labels
        self.gram = np.zeros((1 << GRAM_BITS, n), np.float32)
        self.word = np.zeros((3, 1 << WORD_BITS, n), np.float32)
        self.trans = np.zeros((n, n), np.float32)

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.labels)), np.float32)
        gram, at, slots = _features(w)
        lens = (w.ends - w.starts).astype(np.float32)[:, None]
        e = np.add.reduceat(self.gram[gram], at, axis=0) / lens
        for k in range(3):
            e += self.word[k][slots[k]]
        return e


def _sweep(x: np.ndarray, a: np.ndarray, start: np.ndarray, size: np.ndarray, entry: np.ndarray | None, back: bool) -> np.ndarray:
    """One direction over blocks side by side: states after each word's transition, or transfer matrices where entry is None.

    x: scores of all words; start, size: of blocks, longest first; entry: state before each block's first word.
    The state before a word is what the words before it in the direction say about its label.
    """
    n = x.shape[1]
    state = np.broadcast_to(np.eye(n, dtype=np.float32), (len(start), n, n)).copy() if entry is None else entry.copy()
    out = state if entry is None else np.empty_like(x)
    step = a.T if back else a
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right") if longest else []
    for t in range(longest):
        m = active[t]
        at = start[:m] + (size[:m] - 1 - t if back else t)
        if entry is None:
            now = (state[:m] * x[at][:, None, :]) @ step
            state[:m] = now / now.sum((1, 2), keepdims=True)
        else:
            out[at] = state[:m]
            now = (state[:m] * x[at]) @ step
            state[:m] = now / now.sum(1, keepdims=True)
    return out


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Label probabilities of all words; first: first word of each sequence, and the end.

    Sequences are cut into blocks of BLOCK_WORDS. Transfer matrices of blocks carry the states from
    block to block; then all blocks run side by side, so a long text takes few more steps than a
    short one.
    """
    n_words, n = e.shape
    if not n_words:
        return e
    x = np.exp(e - e.max(1, keepdims=True)).astype(np.float32)
    a = np.exp(trans - trans.max()).astype(np.float32)
    lens = np.diff(first)
    blocks = -(-lens // BLOCK_WORDS)
    begin = np.cumsum(blocks) - blocks  # first block of each sequence
    number = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
    start = np.repeat(first[:-1], blocks) + number * BLOCK_WORDS
    size = np.minimum(np.repeat(lens, blocks) - number * BLOCK_WORDS, BLOCK_WORDS)
    order = np.argsort(-size, kind="stable")
    many = np.flatnonzero(np.repeat(blocks, blocks)[order] > 1)  # only these need matrices
    states = []
    for back in (False, True):
        entry = np.full((len(start), n), 1.0 / n, np.float32)
        if len(many):
            chosen = order[many]
            matrix = np.empty((len(start), n, n), np.float32)
            matrix[chosen] = _sweep(x, a, start[chosen], size[chosen], None, back)
            for k in range(1, int(blocks.max())):
                seq = np.flatnonzero(blocks > k)
                to = begin[seq] + (blocks[seq] - 1 - k if back else k)
                come = to + (1 if back else -1)
                now = np.einsum("bi,bij->bj", entry[come], matrix[come])
                entry[to] = now / now.sum(1, keepdims=True)
        states.append(_sweep(x, a, start[order], size[order], entry[order], back))
    p = states[0] * states[1] * x
    return p / p.sum(1, keepdims=True)


def _marginals(e: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label probabilities, expected transition counts) of sequences of one length: e is sequence x word x label."""
    x, a = np.exp(e - e.max(2, keepdims=True)), np.exp(trans - trans.max())
    alpha, beta = np.empty_like(x), np.ones_like(x)
    length = x.shape[1]
    for t in range(length):
        now = x[:, t] * (alpha[:, t - 1] @ a) if t else x[:, 0]
        alpha[:, t] = now / now.sum(1, keepdims=True)
    for t in range(length - 2, -1, -1):
        now = (x[:, t + 1] * beta[:, t + 1]) @ a.T
        beta[:, t] = now / now.sum(1, keepdims=True)
    p = alpha * beta
    p /= p.sum(2, keepdims=True)
    pair = alpha[:, :-1, :, None] * a * (x * beta)[:, 1:, None, :]
    return p, (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))


def fit(texts: list[bytes], langs: list[str], seed: int = 5) -> Model:
    """Maximum conditional likelihood by AdaGrad on code-switched sequences; deterministic."""
    model = Model(sorted(set(langs)))
    n = len(model.labels)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    w = Words(np.frombuffer(b"".join(texts), np.uint8), offs, _LETTERS, lower=True)
    if n < 2 or not len(w.starts):
        return model
    gram, at, slots = _features(w)
    lens = (w.ends - w.starts).astype(np.int64)
    y = np.array([model.labels.index(x) for x in langs])[w.doc]
    rng = np.random.default_rng(seed)
    g2 = [np.full(x.shape, 1e-6, np.float32) for x in (model.gram, *model.word, model.trans)]
    # Sequences: stretches of 8 to SEQUENCE_WORDS words, laid one after the other in random order, cut every SEQUENCE_WORDS words.
    cuts = [np.arange(a, b, int(rng.integers(8, SEQUENCE_WORDS + 1))) for a, b in zip(w.first[:-1], w.first[1:]) if b > a]
    begins = np.concatenate(cuts)
    stops = np.minimum(np.append(begins[1:], len(y)), w.first[w.doc[begins] + 1])
    for _ in range(EPOCHS):
        order = rng.permutation(len(begins))
        words = np.concatenate([np.arange(begins[k], stops[k]) for k in order])
        length = min(SEQUENCE_WORDS, len(words))
        words = words[: len(words) // length * length]
        step = length * BATCH
        for lo in range(0, len(words), step):
            ids = words[lo : lo + step]
            size = lens[ids]
            where = np.repeat(at[ids] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            owner = np.repeat(np.arange(len(ids)), size)
            e = np.add.reduceat(model.gram[gram[where]], np.cumsum(size) - size, axis=0) / size[:, None]
            for k in range(3):
                e += model.word[k][slots[k][ids]]
            p, dt = _marginals(e.astype(np.float32).reshape(-1, length, n), model.trans)
            gold = y[ids].reshape(-1, length)
            d = p.reshape(-1, n)
            d[np.arange(len(ids)), gold.ravel()] -= 1
            np.add.at(dt, (gold[:, :-1], gold[:, 1:]), -1)
            scaled = (d / size[:, None])[owner]
            grads = [(gram[where], scaled), *((slots[k][ids], d) for k in range(3))]
            for table, g, (slot, value) in zip((model.gram, *model.word), g2, grads):
                used, inv = np.unique(slot, return_inverse=True)
                total = np.stack([np.bincount(inv, value[:, c], len(used)) for c in range(n)], 1).astype(np.float32)
                g[used] += total * total
                table[used] -= 0.2 * (total / np.sqrt(g[used]) + 1e-4 * table[used])
            g2[-1] += dt * dt
            model.trans -= (0.1 * dt / np.sqrt(g2[-1])).astype(np.float32)
    return model


def training_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_lang: int = TRAIN_DOCS) -> list:
    """(text, lang) of a bounded sample: for each language the documents with the smallest hash of their id.

    Languages are counted first; only documents with a hash below what about twice the sample needs
    are looked at, so next to nothing is shuffled, whatever the corpus' size.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.xxhash64(F.col(id_col).cast("string")).alias("h"), F.col(text_col).alias("text"))
    # A row for each label of the model that is about to be fitted, which holds a column of weights for each.
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    if not counts:
        return []
    least = F.create_map(*[x for r in counts for x in (F.lit(r.lang), F.lit(int(min(1.0, (2.0 * per_lang + 50) / r.n) * (1 << 40))))])
    near = rows.where(F.pmod("h", F.lit(1 << 40)) < F.element_at(least, F.col("lang")))
    w = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 40)), "h", "text")
    return near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= per_lang).orderBy("lang", "h", "text").select("text", "lang").collect()


def _has_letters(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


def _predict(shared, text_at: int, keep: list[int]):
    """Adds label and score to the columns to keep."""

    def run(batches):
        model: Model = shared.value
        n = len(model.labels)
        for batch in batches:
            data, starts, ends, valid = text_arrays(batch.column(text_at))
            for i, j in pieces(starts, ends, HELD_BYTES):
                parts, counts = [], []
                for a, b in pieces(starts[i:j], ends[i:j], PIECE_BYTES):
                    w = Words(*joined(data, starts, ends, i + a, i + b), _LETTERS, lower=True)
                    parts.append(model.emissions(w))
                    counts.append(np.diff(w.first))
                first = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64)
                share = np.zeros((j - i, max(n, 1)))
                words = np.diff(first)
                full = np.flatnonzero(words)
                if n and len(full):
                    p = forward_backward(np.concatenate(parts), model.trans, first)
                    share[full] = np.add.reduceat(p, first[:-1][full], axis=0, dtype=np.float64) / words[full][:, None]
                best = share.argmax(1)
                known = (words > 0) & valid[i:j] & (n > 0)
                # A word of bytes beyond ASCII alone may hold no letter: look at those documents' characters.
                for d in np.flatnonzero(known):
                    raw = data[starts[i + d] : ends[i + d]]
                    if not _ascii_letter(raw) and not _has_letters(raw.tobytes()):
                        known[d] = False
                lang = [model.labels[k] if ok else "und" for k, ok in zip(best.tolist(), known.tolist())]
                score = np.where(known, np.minimum(share[np.arange(j - i), best], 1.0), 0.0)
                cols = [batch.column(k).slice(i, j - i) for k in keep]
                release()
                yield pa.RecordBatch.from_arrays([*cols, pa.array(lang, pa.string()), pa.array(score)], [*(batch.schema.names[k] for k in keep), LABEL, SCORE])

    return run


def _ascii_letter(raw: np.ndarray) -> bool:
    head = raw[:256]
    if (((head | 0x20) >= 0x61) & ((head | 0x20) <= 0x7A)).any():
        return True
    return bool((((raw | 0x20) >= 0x61) & ((raw | 0x20) <= 0x7A)).any())


def fit_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from a bounded sample of docs; without usable rows it knows no language."""
    rows = training_sample(docs, id_col, text_col, lang_col)
    return fit([r[0].encode() for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, lang_pred, score (0 to 1), from the text alone.

    A null text, or one without letters, is `und` with score 0, as is all if the model knows no
    language. Equal shares go to the label that sorts first. Repeated rows and null ids stay; other
    columns are not looked at; an empty table gives an empty result. Long texts are read whole, block
    by block; a task holds a few numbers for each word of HELD_BYTES of text, or of one longer text.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.mapInArrow(_predict(spark.sparkContext.broadcast(model), 1, [0]), f"id long, {LABEL} string, {SCORE} double")
    return found.toDF(id_col, "lang_pred", "score")


def keep_identified(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language is known with at least that score."""
    spark = docs.sparkSession
    ship_package(spark)
    cols = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(LABEL, T.StringType()), T.StructField(SCORE, T.DoubleType())])
    found = docs.mapInArrow(_predict(spark.sparkContext.broadcast(model), cols.index(text_col), list(range(len(cols)))), schema)
    return found.where((F.col(LABEL) != "und") & (F.col(SCORE) >= least)).select(*cols)
