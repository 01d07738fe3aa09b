"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word in angle marks gives its whole form and its character n-grams; each is hashed to a row of an
embedding table. A text is the average of its subwords' rows, a linear softmax on it gives the
languages. Both are trained by stochastic gradient descent in numpy, on a bounded sample of whole
labelled texts: by a hash, about `sample` rows and `sample_bytes` bytes, whichever is less, of texts
of `MOST_TEXT` bytes at most. A temperature and a rejection threshold are set on a part of the sample
that training did not see. What is predicted is read whole, however long.

As the model is linear, a word's share of the logits is a fixed vector: workers keep it by word.
Null, empty text or a text without a letter: `und`, score 0, rejected. No labelled rows: all `und`.
Empty table: no rows. Repeated rows (in id, text and language) are learned from once and predicted
alike. Of equally likely languages the first by name. Extra columns stay; the name of the filter's own
column is chosen so that it does not clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import claim, free_name, raw, ship

#: Bytes that reach the driver to learn from, about, and of one text.
SAMPLE_BYTES, MOST_TEXT = 32 << 20, 2 << 20
SAMPLE, BUCKETS, DIM, LENGTHS, EPOCHS = 3000, 1 << 15, 16, (1, 2, 3, 4), 4
#: Texts are learned in stretches of so many words, so that short texts are known as well as long ones.
STRETCH = 24
#: Stretches that training looks at, at most.
STRETCHES = 48_000
#: Words of more characters with their marks are taken in stretches of so many, and not kept by word beyond as many bytes.
LONG = 64
_STRIP = b".,;:!?\"'()[]{}<>|*#$%&+-=_/\\@^~`0123456789"


def normal(text: bytes) -> list[bytes]:
    """Lower-cased words without marks and digits at their ends."""
    return [w for x in text.decode().lower().encode().split() if (w := x.strip(_STRIP))]


class Grams(dict):
    """Row of a subword; short ones are few and come again in nearly every word. Forgets all at `most` of them."""

    def __init__(self, buckets: int, most: int = 400_000):
        super().__init__()
        self.buckets, self.most = buckets, most

    def __missing__(self, gram: str) -> int:
        if len(self) >= self.most:
            self.clear()
        found = self[gram] = xxhash.xxh3_64_intdigest(gram.encode()) % self.buckets
        return found


def subwords(word: bytes, rows: Grams) -> np.ndarray:
    """Rows of the different subwords of a word, in a fixed order; of a long one, of those that start in each stretch."""
    s = f"<{word.decode()}>"
    n = len(s)
    out: list[int] = []
    for at in range(0, n, LONG):
        grams = dict.fromkeys([s[i : i + k] for k in LENGTHS for i in range(at, min(at + LONG, n - k + 1))])
        grams.pop("<", None)
        grams.pop(">", None)
        out += [rows[g] for g in grams]
    if n > max(LENGTHS):
        out.append(xxhash.xxh3_64_intdigest(s.encode()) % rows.buckets)
    return np.array(out, dtype=np.int64)


class Model:
    """table: embeddings; out, bias: the softmax; temperature and threshold: the calibration."""

    def __init__(self, labels: list[str], table: np.ndarray, out: np.ndarray, bias: np.ndarray, temperature: float = 1.0, threshold: float = 0.0):
        self.labels, self.table, self.out, self.bias, self.temperature, self.threshold = labels, table, out, bias, temperature, threshold
        self.words: dict[bytes, int] = {}
        self.grams = Grams(len(table))
        self.room = np.empty((0, len(labels) + 1), dtype=np.float32)

    def __getstate__(self):
        return self.labels, self.table.astype(np.float32), self.out, self.bias, self.temperature, self.threshold

    def __setstate__(self, state):
        self.__init__(*state)

    def rows(self, words: list[bytes], most: int = 300_000) -> np.ndarray:
        """For each word: its share of the logits, and its number of subwords."""
        claim("langid", self.words, self.grams)
        if len(self.words) > most:
            self.words.clear()
        known = self.words
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            need = len(known) + len(new)
            if need > len(self.room):
                grown = np.empty((max(need, 2 * len(self.room), 4096), self.room.shape[1]), dtype=np.float32)
                grown[: len(known)] = self.room[: len(known)]
                self.room = grown
            folded = self.folded()
            for w in new:
                g = subwords(w, self.grams)
                self.room[len(known), :-1] = folded[g].sum(0)
                self.room[len(known), -1] = len(g)
                known[w] = len(known)
        return self.room[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))]

    def folded(self) -> np.ndarray:
        if not hasattr(self, "_folded"):
            self._folded = (self.table @ self.out).astype(np.float32)
        return self._folded

    def logits(self, text: bytes | None) -> np.ndarray | None:
        """None if the text has no letter."""
        if not text:
            return None
        words = normal(text)
        if not any(c.isalpha() for c in text.decode()):
            return None
        if not words:
            return self.bias
        total = self.rows([w for w in words if len(w) <= LONG]).sum(0, dtype=np.float64)
        for w in words:
            if len(w) > LONG:
                g = subwords(w, self.grams)
                total[:-1] += self.folded()[g].sum(0, dtype=np.float64)
                total[-1] += len(g)
        return total[:-1] / max(total[-1], 1) + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        """The language, its calibrated probability, and whether that passes the threshold."""
        z = self.logits(text) if self.labels else None
        if z is None:
            return "und", 0.0, False
        z = z / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.labels[k], float(p[k]), bool(p[k] >= self.threshold)


def train(texts: list[str], langs: list[str], seed: int = 7, buckets: int = BUCKETS, dim: int = DIM, epochs: int = EPOCHS, rate: float = 0.4, keep: float = 0.999) -> Model:
    """Fit the model on whole texts, in stretches; one fifth of the texts sets temperature and threshold."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((1, dim)), np.zeros((dim, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    grams: dict[bytes, np.ndarray] = {}
    rows = Grams(buckets)
    fit, held = [], []
    for i, (t, y) in enumerate(zip(texts, langs, strict=True)):
        words = normal(t.encode())
        k = labels.index(y)
        for at in range(0, len(words), STRETCH):
            (held if i % 5 == 4 else fit).append((words[at : at + STRETCH], k))
    table = rng.normal(0, 0.1, (buckets, dim))
    out, bias = np.zeros((dim, len(labels))), np.zeros(len(labels))

    def ids(words: list[bytes]) -> np.ndarray:
        for w in words:
            if w not in grams:
                grams[w] = subwords(w, rows)
        return np.concatenate([grams[w] for w in words]) if words else np.empty(0, np.int64)

    size = 64
    budget = max(1, min(epochs * len(fit), STRETCHES) // size)  # steps, whatever the sample's length
    for step in range(budget):
        batch = [fit[j] for j in rng.integers(0, len(fit), size)] if fit else []
        parts = [(g, k) for words, k in batch if len(g := ids(words))]
        if not parts:
            break
        flat, sizes = np.concatenate([g for g, _ in parts]), np.array([len(g) for g, _ in parts])
        ends = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        hidden = np.add.reduceat(table[flat], ends, axis=0) / sizes[:, None]
        z = hidden @ out + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(parts)), [k for _, k in parts]] -= 1
        now = rate * (1 - step / budget)
        back = p @ out.T
        out -= now * hidden.T @ p / len(parts) * 8
        bias -= now * p.mean(0)
        step_by = np.repeat(now * 8 * back / sizes[:, None], sizes, axis=0)
        for j in range(dim):
            table[:, j] -= np.bincount(flat, weights=step_by[:, j], minlength=buckets)
    model = Model(labels, table, out, bias)
    check = [(z, k) for words, k in held if (z := model.logits(b" ".join(words))) is not None]
    if check:
        z, y = np.stack([a for a, _ in check]), np.array([k for _, k in check])

        def loss(t: float) -> float:
            s = z / t
            m = s.max(1)
            return float((m + np.log(np.exp(s - m[:, None]).sum(1)) - s[np.arange(len(y)), y]).mean())

        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        s = z / model.temperature
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        right = p.argmax(1) == y
        # the threshold that keeps the asked share of the rightly known stretches, and is never above an even doubt between two
        model.threshold = float(min(0.5, np.quantile(p.max(1)[right], 1 - keep))) if right.any() else 0.0
    return model


def fit_language_model(labelled: DataFrame, text: str = "text", lang: str = "lang", order: str = "doc_id", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """Train on the labelled rows whose hash of `order`, text and language lies in the share of all hashes that holds `sample` rows and `sample_bytes` bytes of them.

    About that many rows and bytes reach the driver, twice as many rows at most; equal rows count once.
    Tasks filter by themselves, so nothing else is sent, however many tasks there are.
    """
    known = F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.octet_length(text) <= MOST_TEXT)
    rows = labelled.filter(known).select(F.col(text).alias("_t"), F.col(lang).alias("_l"), F.pmod(F.xxhash64(order, text, lang), F.lit(1 << 40)).alias("_h"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("_t")), F.lit(0))).first()
    share = min(sample / max(n, 1), sample_bytes / max(size, 1))
    if share < 1:
        rows = rows.filter(F.col("_h") < int((1 << 40) * share))
    found = sorted(rows.dropDuplicates(["_h"]).limit(2 * sample).collect(), key=lambda r: (r["_h"], r["_t"]))
    return train([r["_t"] for r in found], [r["_l"] for r in found], **options)


def identify(docs: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column `out`: lang_pred, score, accepted."""
    ship(docs.sparkSession)

    @F.arrow_udf("struct<lang_pred:string,score:double,accepted:boolean>")
    def predict(texts: pa.Array) -> pa.Array:
        rows = [model.predict(x) for x in raw(texts)]
        cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
        return pa.StructArray.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.bool_())], names=["lang_pred", "score", "accepted"])

    return docs.withColumn(out, predict(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    """True for a fifth of the documents, which are never learned from. A null id counts as the text of null does: not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def language_filter(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """The documents whose language is known well enough, with their own columns."""
    model = fit_language_model(docs.filter(~held_out(doc_id)), text, lang, doc_id)
    out = free_name(docs, "language")
    return identify(docs, model, text, out).filter(F.col(out)["accepted"]).drop(out)
