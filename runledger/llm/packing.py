"""Best-fit packing of token sequences with swap-based local search.

A document is its token ids and one end id; a document longer than the capacity
is cut into full pieces, the first piece taking the remainder.  Pieces are
dealt by hash into groups of bounded size.  Every group is packed on its own:
best fit by decreasing length, then a local search that moves a piece, or
exchanges one for one, one for two or two for one, from an emptier bin to a fuller
one, until no underfull bin can give any more.  Each step raises the sum of squared fills, so the emptiest bins drain
until they are gone.  What is left in loosely filled bins of all groups is
dealt and packed once more, so the loss per group does not add up.

Defined cases: a null or empty text is the end id alone; repeated rows (also
with one doc_id) are packed each; an empty table gives no row; other columns
are ignored.  A document of any length is tokenised whole.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runledger.llm.common import TEXT_ROWS, batch_rows, pieces, read, utf8, written

CAPACITY = 2048
END_ID = 0
GROUP = 4096            # pieces packed together
LOOSE = 0.97            # bins filled less than this go to the second round
DONORS = 12             # emptiest bins that give pieces before the next ones do
CACHED_CHUNKS = 200_000  # chunks kept per worker before its cache begins anew; workers outlive the stage

RUN_BYTES = 1 << 21      # bytes of text encoded together

# Fixed value: the pre-tokenizer's pattern of byte-level vocabularies.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
           r"|\s+(?!\S)|\s+")

# White space that the fast path leaves to the tokenizer: pairs, and every
# character other than a space or line feed that counts as white space.
_ODD = ("  ", " \n", "\n ", "\n\n", *(chr(c) for c in range(0x3001)
        if chr(c).isspace() and chr(c) not in " \n"))


def _byte_letters() -> dict[str, int]:
    """How a byte-level vocabulary spells each byte: printable Latin-1 as it
    is, the others by the letters from U+0100 on."""
    spelled, spare = {}, 256
    for b in range(256):
        plain = 33 <= b <= 126 or 161 <= b <= 255 and b != 173
        spelled[chr(b if plain else spare)] = b
        spare += not plain
    return spelled


class Ids:
    """Token ids of texts as unsigned 32-bit numbers.

    The vocabulary's pre-tokenizer always parts a text before a single space or
    line feed that stands between two non-space characters: a space opens the
    next token and a line feed is a token of its own.  So a text is encoded
    chunk by chunk and equal chunks once.  Unseen chunks of a run of texts are
    encoded in one call by the merge loop of ``tiktoken``, given the vocabulary
    of the tokenizer file (ids are merge ranks there); the byte lengths of the
    ids say where each chunk ends.  Texts with other white space or with the
    string of a special token go to the tokenizer itself, whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in self.tokenizer.get_vocab().items()
                 if t not in self.special}
        self.merge = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks,
                                       special_tokens={}).encode_ordinary
        self.bytes_of = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.bytes_of[i] = len(t)
        # chunks seen so far, and their ids one after the other
        self.known = pa.array([], pa.large_string())
        self.table = np.zeros(0, "<u4")
        self.begins = self.sizes = np.zeros(0, np.int64)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def learn(self, chunks: pa.Array) -> None:
        """Add chunks; one that begins with a line feed stands as it is, any
        other gets a space before it."""
        if len(self.known) > CACHED_CHUNKS:
            self.known, self.table = self.known[:0], self.table[:0]
            self.begins = self.sizes = self.sizes[:0]
        if not len(chunks):
            return
        spaced = pc.binary_join_element_wise(
            pa.scalar(" ", pa.large_string()), chunks, pa.scalar("", pa.large_string()))
        data, ends = utf8(pc.if_else(pc.starts_with(chunks, "\n"), chunks, spaced))
        ids = np.array(self.merge(data.tobytes().decode()), "<u4")
        cut = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[1:]) + 1
        sizes = np.diff(cut, prepend=0)
        self.begins = np.concatenate((self.begins, len(self.table) + cut - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.table = np.concatenate((self.table, ids))
        self.known = pa.concat_arrays([self.known, chunks])

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the n + 1 places between the texts."""
        texts = texts.cast(pa.large_string()).fill_null("")
        plain = np.fromiter(
            (bool(t) and not (t[0].isspace() or t[-1].isspace() or any(x in t for x in _ODD)
                              or any(x in t for x in self.special))
             for t in texts.to_pylist()), bool, len(texts))
        lines = pc.binary_join_element_wise(
            pa.scalar("\n", pa.large_string()), pc.replace_substring(texts, "\n", " \n"),
            pa.scalar("", pa.large_string()))
        lines = pc.if_else(pa.array(plain), lines, pa.scalar("\n", pa.large_string()))
        split = pc.split_pattern(lines, " ")
        bounds = np.asarray(split.offsets).astype(np.int64)
        encoded = split.flatten().dictionary_encode()
        place = pc.index_in(encoded.dictionary, value_set=self.known)
        unseen = encoded.dictionary.filter(pc.is_null(place))
        if len(unseen):
            before = len(self.known)
            self.learn(unseen)
            if len(self.known) < before + len(unseen):      # the cache began anew
                self.learn(encoded.dictionary.filter(pc.is_valid(place)))
            place = pc.index_in(encoded.dictionary, value_set=self.known)
        index = place.to_numpy(zero_copy_only=False)[
            encoded.indices.to_numpy(zero_copy_only=False)]
        size, begin = self.sizes[index], self.begins[index]
        ends = np.cumsum(size)
        at = np.arange(int(ends[-1]) if len(ends) else 0)
        ids = self.table[at + np.repeat(begin - (ends - size), size)]
        cuts = np.concatenate(([0], ends))[bounds]
        # drop the line feed that was put before each text; put in the others
        if plain.all():
            keep = np.ones(len(ids), bool)
            keep[cuts[:-1]] = False
            return ids[keep], cuts - np.arange(len(cuts))
        parts = [ids[cuts[k] + 1 : cuts[k + 1]] if plain[k] else self.encode(texts[k].as_py())
                 for k in range(len(texts))]
        return (np.concatenate(parts),
                np.concatenate(([0], np.cumsum([len(x) for x in parts]))).astype(np.int64))


_loaded: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _loaded:
        _loaded[path] = Ids(path)
    return _loaded[path]


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece, in one pass over the texts."""

    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        encoder = ids_of(tokenizer_path)
        for b in batches:
            rows, doc_ids = [], b.column(0).to_pylist()
            for i, j in pieces(utf8(b.column(1))[1], RUN_BYTES):
                ids, cuts = encoder.texts(b.column(1)[i:j])
                for k in range(j - i):
                    raw = ids[cuts[k] : cuts[k + 1]].tobytes() + end
                    n = len(raw) // 4
                    first = n if n <= capacity else n % capacity or capacity
                    at = piece = 0
                    while at < n:
                        to = at + capacity if piece else first
                        rows.append((doc_ids[i + k], piece, at, to - at,
                                     zlib.crc32(raw[4 * at : 4 * to])))
                        at, piece = to, piece + 1
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(),
                                                       pa.int64(), pa.int64()))],
                ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit by decreasing length: bins as lists of indices."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}   # free space -> bins
    free = 0                          # bit s is set if some bin has s left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = free >> n
        if fits:
            s = n + (fits & -fits).bit_length() - 1
            at = room[s].pop()
            if not room[s]:
                free &= ~(1 << s)
        else:
            s, at = capacity, len(bins)
            bins.append([])
        bins[at].append(i)
        if s > n:
            room.setdefault(s - n, []).append(at)
            free |= 1 << (s - n)
    return bins


def _pair_below(sizes: list[int], most: int) -> tuple[int, int, int] | None:
    """The largest sum of two of ``sizes`` (ascending) that is at most ``most``."""
    best, i, j = None, 0, len(sizes) - 1
    while i < j:
        total = sizes[i] + sizes[j]
        if total > most:
            j -= 1
        else:
            if best is None or total > best[0]:
                best = (total, i, j)
            i += 1
    return best


def _pair_above(sizes: list[int], least: int) -> tuple[int, int, int] | None:
    """The smallest sum of two of ``sizes`` (ascending) that is at least ``least``."""
    best, i, j = None, 0, len(sizes) - 1
    while i < j:
        total = sizes[i] + sizes[j]
        if total < least:
            i += 1
        else:
            if best is None or total < best[0]:
                best = (total, i, j)
            j -= 1
    return best


def _step(lengths, receiver, donor, gap):
    """The best exchange that puts at most ``gap`` more into ``receiver``: (gain, pieces
    given back, pieces taken).  A piece moves, or one is exchanged for one, one for
    two of the donor's, or two for one of the donor's.  Both bins ascend by length."""
    mine, theirs = [lengths[i] for i in receiver], [lengths[i] for i in donor]
    best = (0, None, None)

    def better(gain, back, taken):
        nonlocal best
        if best[0] < gain <= gap:
            best = (gain, back, taken)

    k = bisect_right(theirs, gap)
    if k:                                                        # move
        better(theirs[k - 1], (), (donor[k - 1],))
    for i, a in enumerate(mine):
        k = bisect_right(theirs, gap + a)
        if k:                                                    # one for one
            better(theirs[k - 1] - a, (receiver[i],), (donor[k - 1],))
        if len(theirs) > 1 and (found := _pair_below(theirs, gap + a)):
            total, x, y = found                                  # one for two
            better(total - a, (receiver[i],), (donor[x], donor[y]))
        if best[0] == gap:
            return best
    if len(mine) > 1:
        for j, b in enumerate(theirs):                           # two for one
            if found := _pair_above(mine, b - gap):
                total, x, y = found
                better(b - total, (receiver[x], receiver[y]), (donor[j],))
    return best


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Drain the emptiest bins into the fuller ones while the sum of squared
    fills rises.  The ``DONORS`` emptiest underfull bins give first; when they are
    stuck the next ones do, so the search ends when no underfull bin can give to a
    fuller one (or the count is the least possible)."""
    size = lengths.tolist()
    least = -(-sum(size) // capacity)
    fill = [sum(size[i] for i in b) for b in bins]
    count = len(bins)
    bins = [sorted(b, key=size.__getitem__) for b in bins]
    start, stuck = 0, 0                  # stuck: underfull bins that gave nothing since the last step
    while count > least:
        under = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < capacity),
                       key=lambda k: -fill[k])
        if stuck >= len(under):
            break
        if start >= len(under):
            start = 0
        donors = under[::-1][start:start + DONORS]
        moved = False
        for r in under:
            for d in donors:
                gap = capacity - fill[r]
                if not gap or not bins[r]:
                    break
                if d == r or not bins[d] or fill[d] > fill[r]:
                    continue
                gain, back, taken = _step(size, bins[r], bins[d], gap)
                if not gain:
                    continue
                bins[r] = sorted([i for i in bins[r] if i not in back] + list(taken), key=size.__getitem__)
                bins[d] = sorted([i for i in bins[d] if i not in taken] + list(back), key=size.__getitem__)
                fill[r] += gain
                fill[d] -= gain
                moved = True
                if not bins[d]:
                    count -= 1
        # A chunk that gave goes on giving; else the next emptiest ones do, round and round.
        start, stuck = (start, 0) if moved else (start + DONORS, stuck + len(donors))
    return [b for b in bins if b]


def pack(found: DataFrame, group: Column, capacity: int, base: int) -> DataFrame:
    """Pack every group: sequence_id, offset, fill of the sequence added."""
    schema = PIECE_SCHEMA + ", sequence_id long, offset long, fill long"

    def run(pdf):
        g = int(pdf["g"].iloc[0])
        pdf = pdf.drop(columns="g").sort_values(
            ["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        bins = local_search(best_fit(lengths, capacity), lengths, capacity)
        seq, off, fill = (np.zeros(len(pdf), np.int64) for _ in range(3))
        for k, b in enumerate(bins):
            sizes = lengths[b]
            seq[b], off[b], fill[b] = k, np.cumsum(sizes) - sizes, sizes.sum()
        return pdf.assign(sequence_id=seq + base + g * (2 * GROUP), offset=off, fill=fill)

    return found.withColumn("g", group).groupBy("g").applyInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with batch_rows(docs.sparkSession, TEXT_ROWS):
        found = written(tokenise(docs, tokenizer_path, capacity), "pieces")
    dealt = F.xxhash64("doc_id", "piece", "ids_crc32", "start")

    def groups(n: int) -> Column:
        # a group that meets many equal rows is dealt on by a row number
        return F.pmod(dealt + F.monotonically_increasing_id(), F.lit(max(1, -(-n // GROUP))))

    full = found.where(F.col("length") >= capacity).withColumn(
        "sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    rest = found.where(F.col("length") < capacity)
    once = written(pack(rest, groups(rest.count()), capacity, 0), "packed")
    tight = once.where(F.col("fill") >= LOOSE * capacity)
    loose = once.where(F.col("fill") < LOOSE * capacity)
    again = pack(loose.drop("sequence_id", "offset", "fill"), groups(loose.count()),
                 capacity, 1 << 61)
    names = found.columns + ["sequence_id", "offset"]
    return full.select(names).unionByName(tight.select(names)).unionByName(again.select(names))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read(spark, sf_dir, "documents"),
                          public_tokenizers.path("byte_bpe_50k.json"))
