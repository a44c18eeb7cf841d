"""SentencePiece BPE encoding and decoding by vectorised merge rounds."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vicinal.llm.base import table
from vicinal.llm.flat import parts

NONE = np.iinfo(np.int32).max
#: Encoded segments that a worker keeps; a full cache starts anew.
CACHE = 150_000
#: Longer segments aren't kept.
KEEP = 400


class Pieces:
    """A BPE model with byte fallback: encode() and decode() as the library does, without sampling."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = len(sp)
        self.eos = sp.eos_id()
        self.byte_id = np.full(256, -1, np.int32)
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        normal, score = {}, {}
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
            elif i not in self.special:
                normal[piece], score[piece] = i, sp.get_score(i)
        self.surface = [b""] * n
        for piece, i in normal.items():
            self.surface[i] = piece.replace("▁", " ").encode()
        self.byte_of = {int(i): b for b, i in enumerate(self.byte_id) if i >= 0}
        # symbols: the pieces, then single characters that only occur inside pieces
        self.symbol = dict(normal)
        for piece in normal:
            for c in piece:
                self.symbol.setdefault(c, n + len(self.symbol))
        order = sorted(normal, key=lambda x: -score[x])
        rank = {}
        for x in order:  # equal scores share a rank
            rank[x] = len(rank) if not rank or score[x] != last else rank[prior]  # noqa: F821
            prior, last = x, score[x]  # noqa: F841
        keys, merged, ranks, unsafe = [], [], [], set()
        for x, i in normal.items():
            for k in range(1, len(x)):
                a, b = x[:k], x[k:]
                if a in self.symbol and b in self.symbol:
                    keys.append(self.symbol[a] << 20 | self.symbol[b])
                    merged.append(i)
                    ranks.append(rank[x])
                # once a or b is made, x may come before what was next
                unsafe.update(y for y in (a, b) if y in rank and rank[y] >= rank[x])
        by = np.argsort(keys)
        self.keys, self.merged, self.ranks = np.array(keys, np.int64)[by], np.array(merged, np.int32)[by], np.array(ranks, np.int32)[by]
        #: The most characters that one piece has.
        self.longest = max(map(len, normal))
        self.unsafe = np.zeros(len(rank) + 1, bool)
        self.unsafe[[rank[y] for y in unsafe]] = True
        joined = {c for x in normal if len(x) > 1 for c in x}
        assert not any("▁" in x.lstrip("▁") for x in normal), "a piece holds a space after other characters"
        #: No piece reaches over a space that follows something else, nor over a line feed if no longer piece has one.
        self.segments = re.compile(r"\n+| *[^ \n]+| +" if "\n" not in joined else r" *[^ ]+| +").findall
        self.cache: dict[str, tuple[int, str, bytes]] = {}

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE without one) and index of the merge of each pair."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NONE).astype(np.int32), at

    def merge(self, sym: np.ndarray, seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols and their segments, in order, of symbols whose segment numbers ascend.

        A segment is cut into blocks of twice the longest piece; most have one. Each round takes the least rank in every block and
        merges its pair if no neighbouring block has a lesser one: what any other merge makes holds the place it began at, and no
        piece reaches over a block, so none can come in between. All pairs of that rank that don't overlap go at once, from the
        left, if no merge that this makes possible could come before them; else the block's leftmost only, and after those of the
        block before. So rounds don't grow with a segment's length. Segments without a pair leave.
        """
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, at = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], at[:-1] = self.lookup(sym[:-1], sym[1:])
            rank[:-1][seg[:-1] != seg[1:]] = NONE
        char = np.arange(len(sym))  # symbols keep the place of their first character
        changed = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        block = seg  # one number for segment and block, ascending; each segment's own where all have one block
        if len(sym):
            place = char - np.maximum.accumulate(np.where(changed(seg), char, 0))
            if place.max() >= 2 * self.longest:
                block = seg * (len(sym) + 1) + place // (2 * self.longest)
        single_block = block is seg
        while len(sym):
            first = np.flatnonzero(changed(block))
            size = np.diff(np.append(first, len(sym)))
            least = np.minimum.reduceat(rank, first)
            if single_block:
                over = least == NONE
            else:
                owner = seg[first]
                own = np.flatnonzero(changed(owner))
                over = np.repeat(np.minimum.reduceat(least, own) == NONE, np.diff(np.append(own, len(first))))
            if over.any():
                gone = np.repeat(over, size)
                done.append((sym[gone], char[gone], seg[gone]))
                on = ~gone
                sym, seg, rank, at, char = sym[on], seg[on], rank[on], at[on], char[on]
                block = seg if single_block else block[on]
                if not len(sym):
                    break
                least, size = least[~over], size[~over]
            each = np.repeat(least, size)
            if single_block:
                i = np.flatnonzero(rank == each)
                head = changed(seg[i])
                run = np.concatenate([[True], (i[1:] != i[:-1] + 1) | head[1:]])
                k = np.arange(len(i))
                i = i[((k - np.maximum.accumulate(np.where(run, k, 0))) % 2 == 0) & (head | ~self.unsafe[rank[i]])]
            else:
                owner = seg[np.cumsum(size) - size]
                before, after = np.full((2, len(least)), NONE, np.int32)
                same = owner[1:] == owner[:-1]
                before[1:][same], after[:-1][same] = least[:-1][same], least[1:][same]
                single = self.unsafe[np.minimum(least, len(self.unsafe) - 1)]
                ready = (least < NONE) & (least <= after) & np.where(single, least < before, least <= before)
                i = np.flatnonzero((rank < NONE) & (rank == each))
                of = np.repeat(np.arange(len(least)), size)[i]
                k = np.arange(len(i))
                begin = np.maximum.accumulate(np.where(np.concatenate([[True], (i[1:] != i[:-1] + 1) | (rank[i[1:]] != rank[i[:-1]])]), k, 0))
                i = i[((k - begin) % 2 == 0) & ready[of] & ready[of[begin]] & (changed(of) | ~single[of])]
            sym[i] = self.merged[at[i]]
            keep = np.ones(len(sym), bool)
            keep[i + 1] = False
            new = (np.cumsum(keep) - 1)[i]
            sym, seg, rank, at, char = sym[keep], seg[keep], rank[keep], at[keep], char[keep]
            block = seg if single_block else block[keep]
            for p in (new, new[new > 0] - 1):
                q = p[p + 1 < len(sym)]
                r, t = self.lookup(sym[q], sym[q + 1])
                r[seg[q] != seg[q + 1]] = NONE
                rank[q], at[q] = r, t
                rank[p[p + 1 >= len(sym)]] = NONE
        if not done:
            return sym, seg
        sym, char, seg = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(char, kind="stable")
        return sym[order], seg[order]

    def _learn(self, new: list[str]) -> None:
        """Encode segments and put them into the cache: number of ids, ids as text, decoded bytes."""
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
        get = self.symbol.get
        texts = [s.replace(" ", "▁") for s in new]
        flat = "".join(texts)
        alphabet, codes = np.unique(np.frombuffer(flat.encode("utf-32-le"), np.uint32), return_inverse=True)
        own = np.array([get(chr(c), -1) for c in alphabet.tolist()] or [0], np.int32)
        sym = own[codes] if len(flat) else np.zeros(0, np.int32)
        sym = np.where(sym < 0, -1 - codes, sym).astype(np.int32)  # unknown characters, told apart by place in the alphabet
        size = np.array([len(t) for t in texts], np.int64)
        seg = np.repeat(np.arange(len(texts)), size)
        long_ = np.repeat(size > 2 * self.longest, size)  # apart, as most segments are one block
        got = [self.merge(sym[x], seg[x]) for x in (~long_, long_)]
        sym, seg = (np.concatenate(x) for x in zip(*got, strict=True))
        by = np.argsort(seg, kind="stable")
        sym, seg = sym[by], seg[by]
        cut = np.searchsorted(seg, np.arange(len(texts) + 1)).tolist()
        flat_syms = sym.tolist()
        known = len(self.surface)
        back = {v: c for c, v in self.symbol.items() if v >= known}
        char = lambda s: (chr(alphabet[-1 - s]) if s < 0 else back[s]).encode()
        for k, segment in enumerate(new):
            self._keep(segment, flat_syms[cut[k] : cut[k + 1]], char)

    def _keep(self, segment: str, syms: list[int], char) -> None:  # noqa: ANN001
        ids: list[int] = []
        for s in syms:
            if 0 <= s < len(self.surface):
                ids.append(s)
            else:
                ids.extend(self.byte_id[list(char(s))].tolist())
        self.cache[segment] = (len(ids), " ".join(map(str, ids)), self.bytes_of(ids))

    def bytes_of(self, ids: list[int]) -> bytes:
        surface, byte = self.surface, self.byte_of
        return b"".join(surface[i] or (bytes((byte[i],)) if i in byte else b"") for i in ids)

    def split(self, text: str) -> list[str]:
        return self.segments(" " + text.replace("▁", " ")) if text else []

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """For each text: the number of ids, the ids as text, and the bytes they decode to; the end id is among them."""
        cut = [self.split(t) for t in texts]
        wanted = {s for x in cut for s in x}
        new = [s for s in wanted if s not in self.cache]
        if len(self.cache) + len(new) > CACHE:  # what is needed now is encoded anew
            new = list(wanted)
        if new:
            self._learn(new)
        got = self.cache.__getitem__
        for x in cut:
            found = list(map(got, x))
            ids = " ".join([f[1] for f in found] + [str(self.eos)])
            yield sum(f[0] for f in found) + 1, ids, b"".join(f[2] for f in found)[1:]
        for s in new:
            if len(s) > KEEP:
                del self.cache[s]

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in next(self.encoded([text]))[1].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, the first space dropped; a run of byte ids is UTF-8, each wrong byte one U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            i = 0
            while i < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[i : i + n]).decode())
                        i += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    i += 1
            run.clear()

        first = True
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                first = False
            elif i not in self.special:
                flush()
                text = self.surface[i].decode()
                out.append(text[1:] if first and text[:1] == " " else text)
                first = False
        flush()
        return "".join(out)


_LOADED: dict[bytes, Pieces] = {}


def loaded(model: bytes) -> Pieces:
    """The model, built once in each worker."""
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def model_file(path: str | None = None) -> bytes:
    """The vocabulary file (half a megabyte, whatever the input): it goes with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def tokenized(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have the end id only and decode to nothing; repeated rows get a row each; an empty table gives no rows;
    extra columns are ignored. Texts and segments of any length are merged in rounds. Memory follows the longest text, not the
    batch. Ids are decoded by segment, when a segment is first met: no character's bytes are in two.
    """
    model = model_file(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(model)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for whole in batches:
            for batch in parts(whole, limit=1 << 19):
                rows = [(n, sha(ids.encode()), sha(decoded)) for n, ids, decoded in pieces.encoded([t or "" for t in batch.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in zip(*rows, strict=True))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenized(table(spark, sf_dir, "documents"))
