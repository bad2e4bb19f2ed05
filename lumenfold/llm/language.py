"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts become lower-case words of letters; each word is scored alone, from its start
sign to its end sign, so a word that recurs in a slice of texts is scored once.  A model is fit on a
bounded sample (SAMPLE_DOCUMENTS labelled rows a language at the expectation, chosen by a hash of doc_id); everything else covers
all rows and whole texts.  The models of all languages share, for each order, one sorted array of n-gram
hashes with a column of log probabilities per language, and one of context hashes with the
log weights by which an unseen n-gram falls back on the next shorter one.

A text takes the language with the lowest cross-entropy per letter.  It is rejected if that is above the language's
limit, three quarters of the way from the greatest value among a part of the sample that the counts don't see to
that of letters drawn at random from the alphabet (at least HEADROOM times the former).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm._spark import bound_batches, hot_lookup, materialize
from lumenfold.llm._text import mix, pieces, tenant

ORDER = 4
SAMPLE_DOCUMENTS = 1000
CALIBRATION = 5
HEADROOM = 1.25
#: Bytes of the model that may be sent to every executor.
MAX_MODEL = 256 << 20

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point its lower case if it is a letter, else 0."""
    if not _letters:
        table = np.zeros(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _letters.append(table)
    return _letters[0]


def _words(texts: list[str | None]):
    """Letters of all texts, starts and ends of words, and each word's text."""
    texts = [t or "" for t in texts]
    codes = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letter_table()[codes]
    inside = np.concatenate([[False], letters != 0, [False]])
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return letters, starts, ends, np.searchsorted(starts, begin)


def _distinct(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One occurrence of each distinct word, and for each word which of these it is."""
    n = len(letters)
    power = np.full(n + 1, _P, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(letters.astype(np.uint64)) * power[:n], dtype=np.uint64)])
    # both shifted to the same power, so equal words have equal hashes
    h = mix((sums[ends] - sums[starts]) * power[n - starts])
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return first, inverse


def _padded(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words laid end to end with order - 1 zeros before and a zero behind; where each starts; the places predicted."""
    size = ends - starts + order
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(at[-1], dtype=np.uint32)
    own = np.repeat(np.arange(len(starts)), ends - starts)
    inner = np.arange(len(own)) - np.repeat(np.cumsum(ends - starts) - (ends - starts), ends - starts)
    out[at[:-1][own] + order - 1 + inner] = letters[starts[own] + inner]
    ahead = np.ones(at[-1], bool)
    for k in range(order - 1):
        ahead[at[:-1] + k] = False
    return out, np.concatenate([[0], np.cumsum(size - order + 1)]), np.flatnonzero(ahead)


def _gram_hashes(chars: np.ndarray) -> list[np.ndarray]:
    """chars: a row per n-gram.  Hashes of the last 1, 2, .. characters."""
    out, h = [], np.zeros(len(chars), np.uint64)
    for k in range(chars.shape[1]):
        h = mix(h * _P + chars[:, chars.shape[1] - 1 - k].astype(np.uint64) + _U(1))
        out.append(h)
    return out


@dataclass
class Model:
    """grams[k]: sorted hashes of n-grams of k + 1 characters, logp[k] their log probabilities by language; contexts and fall likewise."""

    languages: list[str]
    order: int = ORDER
    grams: list[np.ndarray] = field(default_factory=list)
    logp: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    fall: list[np.ndarray] = field(default_factory=list)
    unseen: float = 0.0
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def size(self) -> int:
        return sum(a.nbytes for part in (self.grams, self.logp, self.contexts, self.fall) for a in part)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text by language, and the places it sums over."""
        n, languages = len(texts), len(self.languages)
        total, places = np.zeros((n, languages)), np.zeros(n, np.int64)
        letters, starts, ends, at = _words(texts)
        if not len(starts):
            return total, places
        first, inverse = _distinct(letters, starts, ends)
        chars, begin, where = _padded(letters, starts[first], ends[first], self.order)
        logp = np.zeros((len(where), languages), np.float32)
        todo = np.arange(len(where))
        for k in range(self.order - 1, -1, -1):
            window = np.stack([chars[where[todo] - j] for j in range(k, -1, -1)], axis=1)
            h = _gram_hashes(window)[k]
            spot = np.minimum(np.searchsorted(self.grams[k], h), len(self.grams[k]) - 1)
            hit = self.grams[k][spot] == h
            logp[todo[hit]] += self.logp[k][spot[hit]]
            todo, window = todo[~hit], window[~hit]
            if k and len(todo):
                c = _gram_hashes(window[:, :-1])[k - 1]
                spot = np.minimum(np.searchsorted(self.contexts[k], c), len(self.contexts[k]) - 1)
                hit = self.contexts[k][spot] == c
                logp[todo[hit]] += self.fall[k][spot[hit]]
        logp[todo] += np.float32(self.unseen)
        by_word = np.add.reduceat(logp.astype(np.float64), begin[:-1], axis=0)[inverse]
        size = (ends - starts + 1)
        full = np.flatnonzero(np.diff(at))
        total[full] = np.add.reduceat(by_word, at[:-1][full], axis=0)
        places[full] = np.add.reduceat(size, at[:-1][full])
        return total, places


def _totals(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
    return found, first, np.bincount(inverse, weights=values, minlength=len(found))


def _look(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default)
    spot = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[spot] == keys, values[spot], default)


def fit(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """The model of ``counts``: for each language its n-grams (a row of code points each) and how often each occurs."""
    model = Model(sorted(counts), order)
    if not counts:
        return model
    alphabet = np.unique(np.concatenate([g[:, -1] for g, _ in counts.values()]))
    model.unseen = -np.log(len(alphabet) + 1.0)
    lower: list = [None] * len(model.languages)  # (hashes, probabilities) of the next shorter order
    for k in range(order):
        chars, count, seen = [], [], []
        for name in model.languages:
            grams, n = counts[name]
            h = _gram_hashes(grams)
            if k == order - 1:
                own, c = grams, n.astype(float)
            else:  # in how many longer n-grams it ends
                _, first = np.unique(h[k + 1], return_index=True)
                _, at, c = _totals(h[k][first], np.ones(len(first)))
                own = grams[first][at][:, order - 1 - k :]
            chars.append(own)
            count.append(c)
            seen.append(_gram_hashes(own)[k])
        everything = np.concatenate(chars)
        union, first = np.unique(np.concatenate(seen), return_index=True)
        everything = everything[first]
        context = _gram_hashes(everything[:, :-1])[k - 1] if k else np.zeros(len(union), np.uint64)
        suffix = _gram_hashes(everything)[k - 1] if k else None
        fell, folded = [], []
        logp = np.zeros((len(union), len(model.languages)), np.float32)
        contexts = np.unique(context)
        fall = np.zeros((len(contexts), len(model.languages)), np.float32)
        for i in range(len(model.languages)):
            c = count[i]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            own = _gram_hashes(chars[i][:, :-1])[k - 1] if k else np.zeros(len(c), np.uint64)
            ctx, _, total = _totals(own, c)
            _, _, kinds = _totals(own, np.ones(len(c)))
            weight = d * kinds / total
            rest = _look(lower[i][0], lower[i][1], suffix, np.exp(model.unseen)) if k else np.full(len(union), np.exp(model.unseen))
            order_h = np.argsort(seen[i])
            mine = _look(seen[i][order_h], c[order_h], union, 0.0)
            p = np.maximum(mine - d, 0) / _look(ctx, total, context, np.inf) + _look(ctx, weight, context, 1.0) * rest
            logp[:, i] = np.log(p)
            fall[:, i] = np.log(_look(ctx, weight, contexts, 1.0))
            folded.append((union, p))
        model.grams.append(union)
        model.logp.append(logp)
        model.contexts.append(contexts)
        model.fall.append(fall)
        lower = folded
    return model


def _counted(order: int):
    def run(batches):
        tenant("language")
        for rows, _, _ in pieces(batches, "text"):
            texts, names = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for name in sorted(set(names)):
                letters, starts, ends, _ = _words([t for t, x in zip(texts, names, strict=True) if x == name])
                if not len(starts):
                    continue
                first, inverse = _distinct(letters, starts, ends)
                chars, begin, where = _padded(letters, starts[first], ends[first], order)
                times = np.repeat(np.bincount(inverse), np.diff(begin))
                window = np.stack([chars[where - j] for j in range(order - 1, -1, -1)], axis=1)
                _, at, n = _totals(_gram_hashes(window)[-1], times)
                packed = np.ascontiguousarray(window[at]).tobytes()
                grams = pa.array([packed[i : i + 4 * order] for i in range(0, len(packed), 4 * order)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), grams, pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    return run


ADDED = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "accepted": "boolean"}


def _judged(shared, columns: list[str], added: list[str]):
    def run(batches):
        tenant("language")
        model: Model = shared.value
        for rows, _, _ in pieces(batches, "text"):
            texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
            if model.languages:
                total, places = model.score(texts)
                h = -total / np.maximum(places, 1)[:, None]
                best = h.argmin(1)
                at = np.arange(len(h))
                score = 1 / np.exp(np.minimum(places, 50)[:, None] * (h[at, best][:, None] - h)).sum(1)
                yes = places > 0
                taken = yes & (h[at, best] <= model.limits[best]) if len(model.limits) else yes
                out = [pa.array([model.languages[b] if y else "und" for b, y in zip(best, yes, strict=True)]), pa.array(np.where(yes, score, 0.0)), pa.array(h[at, best], mask=~yes), pa.array(taken)]
            else:
                n = rows.num_rows
                out = [pa.array(["und"] * n), pa.array([0.0] * n), pa.nulls(n, pa.float64()), pa.array([True] * n)]
            kept = [rows.column(rows.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *out], names=[*columns, *added])

    return run


def _apply(docs: DataFrame, model: Model, names: tuple[str, ...] = tuple(ADDED)) -> DataFrame:
    if model.size() > MAX_MODEL:
        raise ValueError(f"the model has {model.size()} bytes; at most {MAX_MODEL} may be sent to the executors")
    bound_batches(docs.sparkSession)
    typed = docs.withColumn("text", F.col("text").cast("string"))
    columns = [c for c in typed.columns if c not in names]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in typed.select(*[f"`{c}`" for c in columns]).schema] + [f"`{c}` {t}" for c, t in zip(names, ADDED.values(), strict=True)])
    return typed.select(*[f"`{c}`" for c in columns]).mapInArrow(_judged(docs.sparkSession.sparkContext.broadcast(model), columns, list(names)), schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from all learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE_DOCUMENTS) -> Model:
    """Models of the languages of ``docs`` (doc_id, text, lang) from rows that are not held out, with calibrated limits.

    ``sample`` bounds the expected rows a language.  Rows whose doc_id, text or lang is null teach nothing.
    """
    bound_batches(docs.sparkSession)
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("doc_id is not null and text is not null and lang is not null").filter(~held_out())
    # a hash of doc_id from 0 to 2 ** 63 - 1 against the language's share of that: the expectation holds at any size
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("most", (F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * F.lit(float(2**63 - 1024))).cast("long"))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    taught = hot_lookup(labelled, sizes, ["lang"], "n", "doc_id", ["most"]).filter((F.col("most") >= 2**63 - 4096) | (place < F.col("most"))).select("doc_id", "text", "lang")
    taught = materialize(taught, "taught")
    spared = F.pmod(F.xxhash64(F.lit("calibration"), F.col("doc_id")), F.lit(CALIBRATION)) == 0
    grams = materialize(taught.filter(~spared).select("text", "lang").mapInArrow(_counted(order), "lang string, gram binary, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    if (rows := grams.count()) * 8 * order > MAX_MODEL:
        raise ValueError(f"{rows} n-grams of all languages are more than a model of {MAX_MODEL} bytes holds")
    grams = grams.toArrow()
    counts: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    names = np.array(grams.column("lang").to_pylist(), dtype=object)
    packed = np.frombuffer(b"".join(grams.column("gram").to_pylist()), dtype=np.uint32).reshape(-1, order)
    n = grams.column("n").to_numpy()
    for name in sorted(set(names)):
        counts[name] = packed[names == name], n[names == name]
    model = fit(counts, order)
    if model.languages:
        judged = _apply(taught.filter(spared).select("text", "lang"), model).filter("lang = lang_pred")
        worst = {r["lang"]: r["h"] for r in judged.groupBy("lang").agg(F.max("cross_entropy").alias("h")).collect()}
        model.limits = np.array([max(h * HEADROOM, (h - 3 * model.unseen) / 4) for h in (worst.get(name, np.inf) for name in model.languages)])
    return model


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns as they are, whatever their names.

    Null texts, texts without a letter and those that fit no learned language go; where nothing teaches a language all others stay.
    Rows are judged one by one, so ties and repeated rows have one fate; no rows give none.
    """
    names = tuple(ADDED)
    while set(names) & set(docs.columns):
        names = tuple(f"_{c}" for c in names)
    judged = _apply(docs.withColumn("text", F.col("text").cast("string")), model or learn(docs), names)
    return judged.filter(F.col(names[list(ADDED).index("accepted")])).select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in docs.schema])


def identify(docs: DataFrame, model: Model | None = None, order: int = ORDER, sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and accepted (columns of these names are replaced).

    ``model`` is learned from ``docs`` itself if not given.  lang_pred is ``und`` for null texts and texts without a letter,
    which are not accepted.  score is the language's share of the likelihood over at most 50 letters.  Where
    no row teaches a language, every lang_pred is ``und``, score 0, and all rows are accepted.
    """
    return _apply(docs, model or learn(docs, order, sample))
