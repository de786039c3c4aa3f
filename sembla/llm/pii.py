"""Personal information in free text: a linear-chain conditional random field over word shapes.

The model is trained here, from the labelled table in ``pii_table``; lines are
tagged in numpy batches by Viterbi, and tagged stretches become typed items or
placeholders.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.llm.pii_table import CARRIERS, FUNCTION_WORDS, GENERAL, GENERAL_PLAIN, GIVEN, KINDS, PLAIN, SURNAMES, labelled_lines
from sembla.session import map_arrow

LABELS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
#: Lines a Python worker remembers the items of.
CACHE = 100_000
#: Name-list entries that are read to the driver, at most; the rest of a longer list is not used as a hint.
LEXICON = 1_000_000
#: Tokens of one decoded piece; longer lines are cut at spaces, with an overlap.
PIECE, OVERLAP = 400, 80

_TOKEN = regex.compile(r"[\p{L}\p{M}]+|\p{N}+|[^\s\p{L}\p{N}\p{M}]")
_CHUNK = regex.compile(r"\S+")
_FRONT = regex.compile(r"^(?:[>|\s]|&gt;|</?(?:p|b|i|em|u|strong|div|blockquote|br)\b[^<>]{0,80}>|\[/?[ibu]\])*")
_BACK = regex.compile(r"(?:&nbsp;|</?(?:p|b|i|em|u|strong|div|blockquote|br)\b[^<>]{0,80}>|\[/?[ibu]\])$")
_SIGNED = regex.compile(r"^(?:--+|__+|~~+)$")
_RUNS = regex.compile(r"(\p{N}+)|(\p{Lu}+)|(\p{L}+)")
#: Words that stand inside values and tell of their kind.
_INSIDE = "straße strasse weg close road lane ave st flat calle rue rua reflex at dot van von de di al o example test invalid post mail lists video".split()
_KNOWN = frozenset(w for line in [*CARRIERS, *PLAIN, *GENERAL, *(" ".join(w for w in x.split() if w.islower()) for x in GENERAL_PLAIN), *map(" ".join, FUNCTION_WORDS), " ".join(_INSIDE)] for w in _TOKEN.findall(regex.sub(r"\{\w+\}", " ", line).lower()))


#: What is said of common names without a name list: g given name, s surname.
_COMMON = {w.lower(): "s" for w in SURNAMES} | {w.lower(): "g" for w in GIVEN}


def _shape(w: str) -> str:
    if w[0].isdigit() or w[0].isnumeric():
        return f"d{min(len(w), 10)}"
    if not w[0].isalpha():
        return w
    n = "1" if len(w) == 1 else "2" if len(w) == 2 else "s"
    if w.isupper():
        return "X" + n
    return ("Xx" if w[0].isupper() else "xx") + n


def _chunk_shape(chunk: str) -> str:
    text = _RUNS.sub(lambda m: f"9{min(len(m[1]), 9)}" if m[1] else "A" if m[2] else "a", chunk.strip("\"'<>()[]{},;:!?"))
    return text[:24] if len(text) < 40 else "long"


_digest = xxhash.xxh3_64_intdigest
#: Feature templates per token.
TEMPLATES = 18
_EDGE = [_digest(x) for x in ("^^", "^", "$", "$$")]


class Shapes:
    """Hashes of what is seen of words and of the blank-separated chunks they stand in; remembered per word."""

    def __init__(self, lexicon: dict[str, str]):
        self.lexicon = lexicon
        self._words: dict[str, tuple[int, ...]] = {}
        self._chunks: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"lexicon": self.lexicon, "_words": {}, "_chunks": {}}

    def word(self, w: str) -> tuple[int, ...]:
        """Identity (the word if it is a known one, else its shape), shape, name-list entry, endings."""
        found = self._words.get(w)
        if found is None:
            lower, shape = w.lower(), _shape(w)
            ident = lower if lower in _KNOWN or not (w[0].isalpha() or w[0].isdigit()) else shape
            ends = (_digest(lower[-3:]), _digest(lower[-4:] + shape[0])) if w[0].isalpha() and len(w) > 2 else (0, 0)
            found = (_digest(ident), _digest(shape), _digest(self.lexicon.get(lower, "-")), *ends)
            if len(self._words) > CACHE:
                self._words.clear()
            self._words[w] = found
        return found

    def chunk(self, c: str) -> int:
        """The shape of a chunk."""
        found = self._chunks.get(c)
        if found is None:
            if len(self._chunks) > CACHE:
                self._chunks.clear()
            found = self._chunks[c] = _digest(_chunk_shape(c))
        return found


def _mix(template: int, *parts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of a template's values, for all tokens at once."""
    h = np.uint64(0x9E3779B97F4A7C15 * (template + 1) % 2**64)
    for x in parts:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
    return h


def token_features(lines: list[tuple[str, list[tuple[int, int]], bool]], shapes: Shapes, hints: list[list[str]] | None = None) -> np.ndarray:
    """Feature hashes, tokens x templates, of lines (text, token spans, under a signature mark).

    hints replaces what the name list says.
    """
    words: list[tuple[int, ...]] = []
    ident: list[int] = []
    at: list[int] = []
    lex: list[int] = []
    chunks: list[int] = []
    chunk_at: list[int] = []
    joined: list[int] = []
    place: list[int] = []
    size: list[int] = []
    mark: list[int] = []
    edge_a, edge_b, edge_c, edge_d = _EDGE
    for k, (text, tokens, signed) in enumerate(lines):
        n = len(tokens)
        mine = [shapes.word(text[a:b]) for a, b in tokens]
        words += mine
        ident += (edge_a, edge_b)
        at += range(len(ident), len(ident) + n)
        ident += [w[0] for w in mine]
        ident += (edge_c, edge_d)
        lex.append(1)
        lex += [_digest(h) for h in hints[k]] if hints else [w[2] for w in mine]
        lex.append(2)
        chunks.append(3)
        ends = -1
        found = _CHUNK.finditer(text, tokens[0][0])
        for a, _ in tokens:
            while a >= ends:
                m = next(found)
                ends = m.end()
                chunks.append(shapes.chunk(m[0]))
            chunk_at.append(len(chunks) - 1)
        chunks += (4, 4)
        joined += [0, *(int(x[1] == y[0]) for x, y in zip(tokens, tokens[1:]))]
        place += [1, *[0] * (n - 2), 2] if n > 1 else [3]
        size += [n if n < 4 else 6 if n < 7 else 12 if n < 13 else 13] * n
        mark += [int(signed)] * n
    w = np.array(words, np.uint64)
    shape = w[:, 1]
    pad, i = np.array(ident, np.uint64), np.array(at)
    l, j = np.array(lex, np.uint64), np.arange(len(words))
    row = np.repeat(np.arange(len(lines)), [len(t) for _, t, _ in lines])
    j = j + 2 * row + 1
    c, q = np.array(chunks, np.uint64), np.array(chunk_at)
    join = np.array(joined, np.uint64)
    after = np.append(join[1:], np.uint64(0))
    spot, long, sig = (np.array(x, np.uint64) for x in (place, size, mark))
    me, p1, p2, n1, n2 = pad[i], pad[i - 1], pad[i - 2], pad[i + 1], pad[i + 2]
    rows = [
        (me, join), (p1,), (n1,), (p2, p1), (n1, n2), (p1, me, n1), (join, after, shape), (c[q],), (c[q + 1],), (c[q + 1], c[np.minimum(q + 2, len(c) - 1)]), (l[j],), (l[j - 1], l[j], l[j + 1]),
        (shape, l[j], long, sig), (spot, long, shape, sig), (c[q - 1],), (c[q - 1], c[q]), (w[:, 3],), (w[:, 4],),
    ]
    with np.errstate(over="ignore"):
        return np.stack([_mix(t, *parts) for t, parts in enumerate(rows)], axis=1)


def _ends(text: str) -> tuple[int, int]:
    """Where a line begins and ends without quote marks, blanks and markup."""
    a, b = _FRONT.match(text).end(), len(text.rstrip())
    while b > a and (m := _BACK.search(text, max(a, b - 100), b)):
        b = len(text[: m.start()].rstrip())
    return a, b


def _tokens(text: str) -> list[tuple[int, int]]:
    """Token spans of a line without quote marks and markup at its ends."""
    a, b = _ends(text)
    return [m.span() for m in _TOKEN.finditer(text, a, b)] if b > a else []


def _encode_labels(tokens: list[tuple[int, int]], spans: list[tuple[int, int, str]]) -> list[int]:
    out = []
    for a, b in tokens:
        label = 0
        for s, e, k in spans:
            if s <= a and b <= e:
                label = LABELS.index(("B-" if a == s or not any(s <= x < a for x, _ in tokens) else "I-") + k)
        out.append(label)
    return out


class TaggingModel:
    """Weights of a linear-chain CRF: per feature and label, and per pair of neighbouring labels."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.weights = np.zeros((len(keys) + 1, len(LABELS)), np.float32)
        self.steps = np.zeros((len(LABELS), len(LABELS)), np.float32)
        # an I must follow a B or an I of its kind
        self.barred = np.zeros_like(self.steps)
        self.first = np.zeros(len(LABELS), np.float32)
        for j, label in enumerate(LABELS):
            if label[0] == "I":
                self.first[j] = -1e4
                for i, before in enumerate(LABELS):
                    if before[2:] != label[2:]:
                        self.barred[i, j] = -1e4

    def ids(self, features: np.ndarray) -> np.ndarray:
        """Rows of the weights of feature hashes; the last row, of zeros, for unknown ones."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, features), len(self.keys) - 1)
        return np.where(self.keys[at] == features, at, len(self.keys))

    def emissions(self, ids: np.ndarray) -> np.ndarray:
        return self.weights[ids].sum(axis=1)

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of a padded batch (lines x tokens x labels)."""
        n, t, k = scores.shape
        step = self.steps + self.barred
        best = scores[:, 0] + self.first
        back = np.zeros((n, t, k), np.int8)
        for i in range(1, t):
            both = best[:, :, None] + step[None]
            back[:, i] = both.argmax(1)
            after = both.max(1) + scores[:, i]
            best = np.where((i < lengths)[:, None], after, best)
        out = np.zeros((n, t), np.int8)
        label = best.argmax(1)
        rows = np.arange(n)
        for i in range(t - 1, -1, -1):
            inside = i < lengths
            out[:, i] = np.where(inside, label, 0)
            label = np.where(inside & (i > 0), back[rows, i, label], label)
        return out


def _gradient(model: TaggingModel, scores: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected minus observed counts: per token and label, and per pair of labels (forward-backward, scaled)."""
    n, t, k = scores.shape
    mask = np.arange(t)[None] < lengths[:, None]
    step = np.exp(model.steps + model.barred)
    local = np.exp(scores - scores.max(2, keepdims=True))
    forward = np.zeros((n, t, k))
    forward[:, 0] = local[:, 0] * np.exp(model.first)
    forward[:, 0] /= forward[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (forward[:, i - 1] @ step) * local[:, i]
        forward[:, i] = x / x.sum(1, keepdims=True)
    backward = np.ones((n, t, k))
    for i in range(t - 2, -1, -1):
        x = (local[:, i + 1] * backward[:, i + 1]) @ step.T
        x /= x.sum(1, keepdims=True)
        backward[:, i] = np.where(mask[:, i + 1][:, None], x, 1.0)
    both = forward * backward
    both /= both.sum(2, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(1, t):
        live = mask[:, i]
        if not live.any():
            break
        x = forward[live, i - 1][:, :, None] * step[None] * (local[live, i] * backward[live, i])[:, None, :]
        pairs += (x / x.sum((1, 2), keepdims=True)).sum(0)
        np.subtract.at(pairs, (gold[live, i - 1], gold[live, i]), 1.0)
    rows, cols = np.nonzero(mask)
    both[rows, cols, gold[rows, cols]] -= 1.0
    both[~mask] = 0
    return both, pairs


@lru_cache(maxsize=2)
def train_model(lines: int = 15000, rounds: int = 7, seed: int = 11) -> TaggingModel:
    """The model from ``lines`` fillings of the labelled table, by Adam on the conditional likelihood."""
    rng = random.Random(seed)
    rows, golds, hints = [], [], []
    for text, spans, signed in labelled_lines(lines, seed):
        tokens = _tokens(text)[:PIECE]
        if not tokens:
            continue
        gold = _encode_labels(tokens, spans)
        said = []
        for (a, b), label in zip(tokens, gold):
            # a name list knows some of the names, and a few other words
            word = text[a:b]
            r = rng.random()
            if word.lower() in _COMMON:
                said.append(_COMMON[word.lower()])
            elif not word[0].isalpha() or len(word) < 3 or word.lower() in _KNOWN:
                said.append("-")
            elif LABELS[label].endswith("name"):
                said.append(rng.choice("gs") if r < 0.4 else "-")
            else:
                said.append(rng.choice("gs") if r < 0.06 else "-")
        rows.append((text, tokens, signed))
        golds.append(np.array(gold))
        hints.append(said)
    features = token_features(rows, Shapes({}), hints)
    keys, counts = np.unique(features, return_counts=True)
    model = TaggingModel(keys[counts >= 3])
    cuts = np.cumsum([len(g) for g in golds])[:-1]
    data = sorted(zip(np.split(model.ids(features), cuts), golds), key=lambda x: len(x[1]))
    batches = [_Batch(data[i : i + 120]) for i in range(0, len(data), 120)]
    m = np.zeros_like(model.weights)
    v = np.zeros_like(model.weights)
    ms, vs = np.zeros_like(model.steps), np.zeros_like(model.steps)
    # the mean over the second half of the rounds is steadier than the last state
    mean, mean_steps, taken = np.zeros_like(model.weights), np.zeros_like(model.steps), 0
    shuffle = np.random.default_rng(seed)
    for round_ in range(rounds):
        rate = 0.08 * (1 - round_ / rounds) + 0.005
        for k, at in enumerate(shuffle.permutation(len(batches)).tolist()):
            batch = batches[at]
            n = len(batch.lengths)
            local, pairs = _gradient(model, batch.scores(model), batch.gold, batch.lengths)
            used = batch.used
            g = np.add.reduceat(local[batch.inside].astype(np.float32)[batch.tokens], batch.starts) / n + np.float32(2e-4) * model.weights[used]
            first, second = 0.9 * m[used] + 0.1 * g, 0.99 * v[used] + 0.01 * g * g
            m[used], v[used] = first, second
            model.weights[used] -= rate * first / (np.sqrt(second) + 1e-6)
            gs = pairs / n
            ms, vs = 0.9 * ms + 0.1 * gs, 0.99 * vs + 0.01 * gs * gs
            model.steps -= rate * ms / (np.sqrt(vs) + 1e-6)
            model.weights[-1] = 0
            if 2 * round_ >= rounds and k % 20 == 0:
                mean += model.weights
                mean_steps += model.steps
                taken += 1
    if taken:
        model.weights, model.steps = mean / taken, mean_steps / taken
    return model


class _Batch:
    """Lines of one training step: their features, labels, and where each feature stands."""

    def __init__(self, lines: list[tuple[np.ndarray, np.ndarray]]):
        self.lengths = np.array([len(g) for _, g in lines])
        self.inside = np.arange(self.lengths.max())[None] < self.lengths[:, None]
        self.ids = np.concatenate([ids for ids, _ in lines])
        self.gold = np.zeros(self.inside.shape, np.int64)
        self.gold[self.inside] = np.concatenate([g for _, g in lines])
        order = np.argsort(self.ids.ravel(), kind="stable")
        self.used, self.starts = np.unique(self.ids.ravel()[order], return_index=True)
        self.tokens = order // TEMPLATES

    def scores(self, model: TaggingModel) -> np.ndarray:
        out = np.zeros((*self.inside.shape, len(LABELS)), np.float32)
        out[self.inside] = model.emissions(self.ids)
        return out


class Tagger:
    """Finds items in texts with a trained model and a name list."""

    def __init__(self, model: TaggingModel, lexicon: dict[str, str]):
        self.model, self.shapes = model, Shapes(_COMMON | lexicon)
        self._seen: dict[tuple[str, bool], list[tuple[int, int, str]]] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_seen": {}}

    def _pieces(self, line: str) -> list[tuple[list[tuple[int, int]], int, int]]:
        """Pieces of a line's tokens, and between which places an item must begin to count in the piece."""
        tokens = _tokens(line)
        starts = list(range(0, max(1, len(tokens) - OVERLAP), PIECE - OVERLAP)) if tokens else []
        half, out = OVERLAP // 2, []
        for k, a in enumerate(starts):
            piece = tokens[a : a + PIECE]
            low = tokens[a + half][0] if k else 0
            high = tokens[a + PIECE - half][0] if k + 1 < len(starts) else len(line) + 1
            out.append((piece, low, high))
        return out

    def tag(self, lines: list[tuple[str, bool]]) -> None:
        """Tags lines that weren't seen yet, in batches of similar length."""
        model = self.model
        work = []
        for key in lines:
            self._seen[key] = []
            work += [(key, *piece) for piece in self._pieces(key[0])]
        work.sort(key=lambda x: len(x[1]))
        for at in range(0, len(work), 256):
            batch = work[at : at + 256]
            lengths = np.array([len(t) for _, t, _, _ in batch])
            flat = model.emissions(model.ids(token_features([(line, t, signed) for (line, signed), t, _, _ in batch], self.shapes)))
            scores = np.zeros((len(batch), int(lengths.max()), len(LABELS)), np.float32)
            scores[np.arange(scores.shape[1])[None] < lengths[:, None]] = flat
            for (key, tokens, low, high), path in zip(batch, model.viterbi(scores, lengths)):
                for a, b, kind in _spans(tokens, path[: len(tokens)].tolist()):
                    item = checked(key[0], a, b, kind) if low <= a < high else None
                    if item:
                        self._seen[key].append(item)
        for key in lines:
            kept: list[tuple[int, int, str]] = []
            for item in sorted(self._seen[key]):
                if not kept or item[0] >= kept[-1][1]:
                    kept.append(item)
            self._seen[key] = kept

    def items(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the items of every text, in order."""
        if len(self._seen) > CACHE:
            self._seen.clear()
        cut = []
        for text in texts:
            rows, at, since = [], 0, 99
            for line in (text or "").split("\n"):
                since = 0 if _SIGNED.match(_bare(line)) else since + 1
                rows.append((at, (line, 0 < since <= 5)))
                at += len(line) + 1
            cut.append(rows)
        self.tag(list({key for rows in cut for _, key in rows if key not in self._seen}))
        return [[(a + at, b + at, k) for at, key in rows for a, b, k in self._seen[key]] for rows in cut]


def _bare(line: str) -> str:
    a, b = _ends(line)
    return line[a:b]


def _spans(tokens: list[tuple[int, int]], path: list[int]) -> Iterator[tuple[int, int, str]]:
    start = None
    for (a, b), label in zip([*tokens, (0, 0)], [*path, 0]):
        if start is not None and LABELS[label][0] != "I":
            yield start, end, kind
            start = None
        if LABELS[label][0] == "B":
            start, kind = a, LABELS[label][2:]
        end = b


_EMAIL = regex.compile(r"[\p{L}\p{N}._+-]+(?: ?(?:@|\(at\)|\[at\]|&#64;) ?| at )[\p{L}\p{N}-]+(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?| dot )[\p{L}\p{N}-]+)+", regex.I)
_NAME = regex.compile(r"[\p{L}\p{M}'’´`.-]+(?:,? [\p{L}\p{M}'’´`.-]+){1,4}")


def checked(line: str, a: int, b: int, kind: str) -> tuple[int, int, str] | None:
    """The exact check of a tagged stretch: what can't be an item of its kind is dropped, cut-off ends are completed."""
    text = line[a:b]
    digits = sum(c.isdigit() for c in text)
    if kind == "email":
        if _EMAIL.fullmatch(text):
            return a, b, kind
        for m in _EMAIL.finditer(line, max(0, a - 80), min(len(line), b + 80)):
            if m.start() < b and a < m.end():
                return m.start(), m.end(), kind
        return None
    if kind == "phone":
        return (a, b, kind) if 9 <= digits <= 15 else None
    if kind == "idnum":
        return (a, b, kind) if 7 <= digits <= 14 else None
    if kind == "address":
        return (a, b, kind) if digits and sum(c.isalpha() for c in text) > 4 else None
    return (a, b, kind) if not digits and _NAME.fullmatch(text.strip()) else None


def _lexicon(names: DataFrame | None, token: str, kind: str) -> dict[str, str]:
    if names is None:
        return {}
    rows = names.where(F.col(token).isNotNull()).select(F.lower(token), kind).limit(LEXICON).collect()
    out: dict[str, str] = {}
    for word, what in rows:
        out[word] = "s" if what == "surname" else out.get(word, "g")
    return out


def _tagged(docs: DataFrame, key: str, text: str, names: DataFrame | None, token: str, token_kind: str, make, schema: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(Tagger(train_model(), _lexicon(names, token, token_kind)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                texts = part.column(1).to_pylist()
                made = make(part.column(0), texts, tagger.items(texts))
                if made is not None:
                    yield made

    return docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).transform(map_arrow, run, schema)


def personal_items(docs: DataFrame, key: str, text: str, names: DataFrame | None = None, token: str = "token", token_kind: str = "token_kind") -> DataFrame:
    """Columns key, kind, value, value_key: every different item of personal information in every text.

    kind is email, phone, idnum, address or name; value is a smallest spelling in
    the text, value_key its lower-cased letters and digits. names is an optional
    list of given names and surnames (a bounded hint). A narrow map over the rows,
    then one aggregation; the model (about 1 MB) and the list are broadcast.

    Edge cases: null and empty texts have no items; texts may have any length (they
    are tagged line by line, long lines in overlapping pieces); repeated rows count
    once; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make(keys: pa.Array, texts: list, found: list) -> pa.RecordBatch | None:
        rows = [(i, k, texts[i][a:b]) for i, items in enumerate(found) for a, b, k in items]
        if not rows:
            return None
        plain = ["".join(c for c in v.lower() if c.isalpha() or c.isnumeric()) for _, _, v in rows]
        return pa.RecordBatch.from_arrays([keys.take(pa.array([r[0] for r in rows])), pa.array([r[1] for r in rows]), pa.array([r[2] for r in rows]), pa.array(plain)], names=["k", "kind", "value", "value_key"])

    out = _tagged(docs, key, text, names, token, token_kind, make, f"k {kind}, kind string, value string, value_key string")
    return out.groupBy(F.col("k").alias(key), "kind", "value_key").agg(F.min("value").alias("value"))


def redact_personal(docs: DataFrame, key: str, text: str, names: DataFrame | None = None, token: str = "token", token_kind: str = "token_kind", out: str = "redacted") -> DataFrame:
    """Columns key, redacted: each text with every item replaced by a placeholder such as [EMAIL].

    What is no item stays as it is. A null text stays null; edge cases as in personal_items,
    but every row gives a row.
    """
    kind = docs.schema[key].dataType.simpleString()

    def make(keys: pa.Array, texts: list, found: list) -> pa.RecordBatch:
        changed = []
        for t, items in zip(texts, found):
            for a, b, k in reversed(items):
                t = f"{t[:a]}[{k.upper()}]{t[b:]}"
            changed.append(t)
        return pa.RecordBatch.from_arrays([keys, pa.array(changed, pa.string())], names=["k", "t"])

    made = _tagged(docs, key, text, names, token, token_kind, make, f"k {kind}, t string")
    return made.select(F.col("k").alias(key), F.col("t").alias(out))
