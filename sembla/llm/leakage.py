"""Evaluation passages in training text: template windows, hash join, slot-consistent verification.

Both sides become words, and words become typed templates (numbers, units and names
are placeholders). Hashed windows of templates, and of words with their values, are
hash-joined in Spark; where windows of an item agree on a place, the words are
compared one by one: literally, and with the slots bound to values.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sembla.session import map_arrow, write_table

# Letters of other scripts that look like a Latin letter, and the letter each looks like.
LOOKALIKES = "аеорсухіјѕԁһԛԝьгвкмнтΑΒΕΖΗΙΚΜΝΟΡΤΥΧαοερικυνηωАВЕЅІЈКМНОРСТУХҮɡıɑ"
LOOKS_LIKE = "aeopcyxijsdhqwbrbkmhtABEZHIKMNOPTYXaoepikuvnwABESIJKMHOPCTYXYgia"
# Number words and units that a template replaces by their type.
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
UNITS = "mm cm m km g kg t ml l s ms min h hz khz mhz ghz kb mb gb tb px fps w kw v a percent usd eur gbp dollars euros pounds metres meters miles feet inches litres seconds minutes hours days weeks months years".split()

#: Words of a template window and of a bound window (slots with their values).
TEMPLATE, BOUND = 5, 4
#: Share of the items that hold a fixed word, at least.
COMMON = 0.06
#: Fixed words that a window needs, besides the commonest.
ANCHORS = 2
#: Words of all items together up to which items and their windows are broadcast (about 16 MB); beyond, they are joined by shuffle.
BROADCAST_WORDS = 500_000
#: Bits of the map of window hashes that documents are looked up in before the join (2 MB, whatever the number of items).
MAP_BITS = 1 << 24
#: Different words a worker remembers the codes of.
VOCABULARY = 1_000_000

# Names of tags that are markup, in angle and in square brackets; the first ones end a line.
BLOCK_TAGS = "br p div li ul ol tr td th table hr pre blockquote h1 h2 h3 h4 h5 h6"
INLINE_TAGS = "a abbr b big center cite code del em font i img ins kbd mark q s small span strike strong sub sup tbody thead tt u"
BRACKET_TAGS = "b i u s url img quote code list color size font center left right spoiler email youtube video attach table tr td"

_ANGLE = regex.compile(rf"</?({'|'.join((BLOCK_TAGS + ' ' + INLINE_TAGS).split())})(?:\s+[\w:-]+\s*=\s*(?:\"[^\"<>]*\"|'[^'<>]*'|[^\s<>]+))*\s*/?>", regex.I)
_BRACKET = regex.compile(rf"\[/?(?:{'|'.join(BRACKET_TAGS.split())}|\*)(?:=[^\[\]\n]*)?\]|\[quote(?:\s+\w+=[^\[\]\n]*)\]", regex.I)
_BLOCKS = frozenset(BLOCK_TAGS.split())
_QUOTE = regex.compile(r"^(?:[ \t]*[>|])+", regex.M)
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PLAIN_WORD = regex.compile(r"[a-z0-9]+")
_WRAP = regex.compile(r"(?<=\p{L})-[ \t]*\r?\n\s*(?=\p{Ll})")
_HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
_TABLE = str.maketrans(LOOKALIKES, LOOKS_LIKE)


def words_of(text: str | None) -> list[str]:
    """Words of a text in one look: no markup, quote marks, case, accents, invisible or look-alike letters.

    Known tags (with attributes) vanish; other text in brackets stays.
    """
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _ANGLE.sub(lambda m: "\n" if m[1].lower() in _BLOCKS else "", text)
    if "[" in text:
        text = _BRACKET.sub("", text)
    if ">" in text or "|" in text:
        text = _QUOTE.sub("", text)
    if "-" in text:
        text = _WRAP.sub("", text)
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower())
    text = _HIDDEN.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(_HIDDEN.sub("", text.translate(_TABLE)).lower())


class Templates:
    """Turns words into typed templates: fixed words stay, numbers, units and names become placeholders.

    frequencies: in how many of the ``total`` items a word stands. Fixed words are those that
    at least ``common`` of the items hold; a word that fewer hold is a name. Words
    that ``stop`` of the items hold don't anchor a window.
    """

    def __init__(self, frequencies: dict[str, int], total: int, common: float = COMMON, stop: float = 0.6):
        n = max(1, total)
        self.fixed = frozenset(w for w, c in frequencies.items() if c >= max(2, common * n))
        self.plain = frozenset(w for w in self.fixed if frequencies[w] >= stop * n)
        self.kinds = {w: "<num>" for w in NUMBER_WORDS} | {w: "<unit>" for w in UNITS if w not in self.plain}
        self._forget()

    def __getstate__(self) -> dict:
        return {"fixed": self.fixed, "plain": self.plain, "kinds": self.kinds}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[str, int] = {}
        self._codes: list[tuple[int, int, bool, bool]] = []

    def form(self, w: str) -> str:
        """The word itself if it is fixed, else its placeholder."""
        return self.kinds.get(w) or (w if w in self.fixed else "<num>" if w[0].isdigit() else "<name>")

    def _number(self, w: str) -> int:
        digest, form = xxhash.xxh3_64_intdigest, self.form(w)
        slot = form[0] == "<"
        self._codes.append((digest(w), digest(form), slot, not slot and w not in self.plain))
        found = self._numbers[w] = len(self._codes) - 1
        return found

    def windows(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows of several texts, the text each stands in and the position it begins at, in that order."""
        if len(self._codes) > VOCABULARY:
            self._forget()
        known, add = self._numbers, self._number
        ids = np.array([known[w] if w in known else add(w) for words in texts for w in words], np.int64)
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        literal, template = (np.array([c[i] for c in self._codes], np.uint64)[ids] for i in (0, 1))
        slot, anchor = (np.array([c[i] for c in self._codes], bool)[ids] for i in (2, 3))
        sizes = np.array([len(words) for words in texts])
        row = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        room = np.repeat(sizes, sizes) - place
        slots, anchors = (np.concatenate([[0], np.cumsum(x)]) for x in (slot, anchor))
        hashes, rows, places = [], [], []
        for kind, (code, width) in enumerate(((literal, BOUND), (template, TEMPLATE))):
            at = np.flatnonzero(room >= width)
            anchored = anchors[at + width] - anchors[at] >= ANCHORS
            # a bound window says which values fill its slots; without an anchor or slot it says nothing
            # and a template one needs anchors, or different fixed words but for one slot at most
            filled = slots[at + width] - slots[at]
            good = anchored | (filled > 0) if not kind else anchored
            if kind:
                some = np.flatnonzero(~anchored & (filled <= 1))
                many = np.ones(len(some), bool)
                for j in range(width):
                    for k in range(j):
                        many &= code[at[some] + j] != code[at[some] + k]
                good[some[many]] = True
            at = at[good]
            h = np.full(len(at), 0x9E3779B97F4A7C15 + kind, np.uint64)
            with np.errstate(over="ignore"):
                for j in range(width):
                    h = (h ^ code[at + j]) * np.uint64(0xD6E8FEB86659FD93)
                    h ^= h >> np.uint64(32)
            hashes.append(h.view(np.int64))
            rows.append(row[at])
            places.append(place[at])
        h, r, p = (np.concatenate(x) for x in (hashes, rows, places))
        order = np.lexsort((p, r))
        return h[order], r[order], p[order].astype(np.int32)


def _longest(agrees: np.ndarray, cost: float) -> tuple[int, int] | None:
    """(first, last) of the longest stretch that begins and ends in agreement and whose agreements pay for its differences."""
    starts = np.flatnonzero(agrees)
    if not len(starts):
        return None
    total = np.concatenate([[0.0], np.cumsum(np.where(agrees, 1.0, -cost))])
    highest = np.maximum.accumulate(total[::-1])[::-1]
    # the last place at which the sum isn't below that before the start; differences at the end are cut off
    last = np.searchsorted(-highest, -(total[starts] - 1e-9), "right") - 1
    ends = starts[np.searchsorted(starts, np.maximum(last - 1, starts), "right") - 1]
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def best_passage(doc: list[str], item: list[str], diagonals: list[int], templates: Templates, least: int, slack: float = 1 / 6) -> tuple[int, int, bool]:
    """(words, differing words, literal) of the longest passage of the item that stands in the document.

    A diagonal is a shift of the item against the document. A passage begins and ends
    with agreeing words, and at most ``slack`` of its words differ. Literally, words
    agree when they are equal; diagonals side by side are joined, so that a word that
    was split, joined or dropped doesn't end a passage. If no literal passage has
    ``least`` words, fixed words have to be equal and slots consistent: a slot agrees
    when it is filled with a value of its type, and one item value always meets the same
    document value and the other way round (the commonest pair counts, others differ).
    A sixth of such a passage, and four words, have to be equal ones.
    """
    cost = 1 / slack - 1
    best, bound = (0, 0, True), (0, 0, False)
    words, text = np.array(item, object), np.array(doc, object)
    for shift in sorted(set(diagonals)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        if high - low < 1:
            continue
        mine, theirs = words[low:high], text[low + shift : high + shift]
        equal = (mine == theirs).astype(bool)
        same = equal.copy()
        for near in (-1, 1):
            # past a dropped or split word the rest stands one place further
            at = np.arange(low, high) + shift + near
            inside = (at >= 0) & (at < len(doc))
            side = np.zeros(len(mine), bool)
            side[inside] = mine[inside] == text[at[inside]]
            same |= side & (np.convolve(side, np.ones(3), "same") >= 3)
        found = _longest(same, cost)
        if found and found[1] - found[0] >= best[0]:
            n = found[1] - found[0] + 1
            best = (n, n - int(same[found[0] : found[1] + 1].sum()), True)
        if best[0] >= least:
            continue
        found = _longest(equal | _consistent(mine, theirs, templates), cost)
        if found and found[1] - found[0] >= bound[0]:
            n, equals = found[1] - found[0] + 1, int(equal[found[0] : found[1] + 1].sum())
            if equals >= max(4, n / 6):
                bound = (n, n - equals, False)
    return best if best[0] >= least else bound


def _consistent(item: np.ndarray, doc: np.ndarray, templates: Templates) -> np.ndarray:
    """Where two words of one slot type meet and both are, for the most part of their slots, bound to each other."""
    forms = [(templates.form(a), templates.form(b)) for a, b in zip(item, doc)]
    slot = np.array([a == b and a[0] == "<" for a, b in forms], bool)
    if not slot.any():
        return slot
    pairs: dict[tuple[str, str], int] = {}
    for i in np.flatnonzero(slot):
        pairs[item[i], doc[i]] = pairs.get((item[i], doc[i]), 0) + 1
    to: dict[str, str] = {}
    back: dict[str, str] = {}
    for (a, b), _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0])):
        if a not in to and b not in back:
            to[a], back[b] = b, a
    return slot & np.array([to.get(a) == b for a, b in zip(item, doc)], bool)


def _template_frequencies(items: DataFrame, common: float) -> tuple[dict[str, int], int, int]:
    """How many items hold each of the words that at least ``common`` of them hold, the number of items, and of their words.

    At most (words of an item on average) / common rows reach the driver.
    """
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    rows = items.select(F.explode(F.array_distinct("words")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= max(2, common * n))
    return {r.w: r.c for r in rows.collect()}, n, total


def leaked_items(docs: DataFrame, doc_key: str, text: str, items: DataFrame, item_key: str, item_text: str, least: int = 14, broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """Columns doc key, item key, words, changed, literal: every document with the items that leaked into it.

    Both sides become words without markup, quoting, case, accents and look-alike
    letters; windows of words whose numbers, units and names are typed placeholders
    (and shorter ones with the values) are hash-joined; where two windows of an item
    agree on a place, the words are compared one by one. A passage has at least ``least``
    words from its first to its last agreeing word, of which at most one in six
    differs. It is literal where words have to be equal; otherwise the question was
    asked again with other values: fixed words are equal, and slots are consistent.
    Then ``changed`` counts the words that aren't equal.

    Documents are looked up in a bit map of the items' window hashes (of fixed size)
    before the join, so that a window reaches the join only if an item may have it.
    Documents of the same words are compared once. Items and their windows are
    broadcast up to broadcast_words words, else joined by shuffle; the rows are the same.

    Edge cases: null or empty texts on either side match nothing; a null document
    key is kept as a key, a null item key is not; repeated documents give repeated
    rows only once; repeated items count once; items with fewer words than ``least``
    never match; empty tables give no rows; other columns are ignored.
    """
    kind = docs.schema[doc_key].dataType.simpleString()
    wanted = items.where(F.col(item_text).isNotNull() & F.col(item_key).isNotNull()).select(F.col(item_key).cast("long").alias("item"), F.col(item_text).cast("string").alias("text")).distinct()
    asked, _ = write_table(wanted.transform(map_arrow, _item_words, "item long, words array<string>"), "items")
    frequencies, n, total = _template_frequencies(asked, COMMON)
    templates = Templates(frequencies, n)
    windows, _ = write_table(asked.transform(map_arrow, _item_windows(templates), "item long, h long, at int"), "windows")
    small = total <= broadcast_words
    bits = _bit_map(windows)

    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_key).alias("doc"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    hits = f"doc {kind}, fp binary, words string, near array<struct<h: long, p: int>>"
    candidates, _ = write_table(source.transform(map_arrow, _document_hits(templates, shared, least), hits), "candidates")
    once = candidates.dropDuplicates(["fp"])
    light = F.broadcast if small else (lambda x: x)
    met = once.select("fp", F.inline("near")).join(light(windows), "h").groupBy("fp", "item", (F.col("p") - F.col("at")).alias("shift")).agg(F.count(F.lit(1)).alias("n"))
    pairs = met.groupBy("fp", "item").agg(F.collect_list(F.struct("shift", "n")).alias("shifts")).where(F.aggregate("shifts", F.lit(0).cast("long"), lambda s, x: s + x["n"]) >= 2)
    both = pairs.join(once.select("fp", "words"), "fp").join(light(asked.withColumnRenamed("words", "passage")), "item").select("fp", "item", "words", "passage", "shifts")
    found, _ = write_table(both.transform(map_arrow, _verify(templates, least), "fp binary, item long, words int, changed int, literal boolean"), "passages")
    out = candidates.select("doc", "fp").join(found, "fp").groupBy("doc", "item").agg(F.max(F.struct("literal", "words", "changed")).alias("m"))
    return out.select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "m.words", "m.changed", "m.literal")


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([words_of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], names=["item", "words"])


def _item_windows(templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, row, at = templates.windows(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(h), pa.array(at)], names=["item", "h", "at"])

    return run


def _bit_map(windows: DataFrame) -> np.ndarray:
    """A bit for every value of hash mod MAP_BITS that a window has; built in blocks of 4 KB, MAP_BITS / 32768 at most."""
    spot = F.pmod("h", F.lit(MAP_BITS)) + 1
    blocks = windows.select(F.bitmap_bucket_number(spot).alias("block"), F.bitmap_bit_position(spot).alias("bit")).groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits"))
    out = np.zeros((MAP_BITS // 32768, 4096), np.uint8)
    for r in blocks.collect():
        out[r.block - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _document_hits(templates: Templates, shared, least: int, step: int = 500):
    """Documents with at least two windows that an item may have: a fingerprint of their words, the words, and these windows."""
    near = pa.struct([("h", pa.int64()), ("p", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, step):
                part = batch.slice(a, step)
                texts = [words_of(t) for t in part.column(1).to_pylist()]
                h, row, place = templates.windows([w if len(w) >= least // 2 else [] for w in texts])
                spot = h & (MAP_BITS - 1)
                hit = (bits[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
                h, row, place = h[hit], row[hit], place[hit]
                counts = np.bincount(row, minlength=part.num_rows)
                keep = counts[row] >= 2
                h, row, place = h[keep], row[keep], place[keep]
                rows = np.flatnonzero(counts >= 2)
                if not len(rows):
                    continue
                joined = [" ".join(texts[i]) for i in rows.tolist()]
                offsets = np.concatenate([[0], np.cumsum(counts[rows])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(h), pa.array(place)], fields=list(near)))
                prints = pa.array([xxhash.xxh3_128_digest(t) for t in joined], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), prints, pa.array(joined), lists], names=["doc", "fp", "words", "near"])

    return run


def _verify(templates: Templates, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k, (words, passage, shifts) in enumerate(zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)))):
                count = {s["shift"]: s["n"] for s in shifts}
                # hits of one shift, or of shifts next to it, say that slots and fixed words agree in order
                good = [s for s, c in count.items() if c + count.get(s - 1, 0) + count.get(s + 1, 0) >= 2]
                if good and len(passage) >= least:
                    found = best_passage(words.split(" "), passage, good, templates, least)
                    if found[0] >= least:
                        rows.append(k)
                        out.append(found)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([f[i] for f in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.bool_())))], names=["fp", "item", "words", "changed", "literal"])

    return run
