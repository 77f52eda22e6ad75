"""SentencePiece encoding and decoding by suffix-array matching.

The units of a batch (a run of spaces and what follows, which no piece crosses) are laid end to end, once each.
The text's suffixes are sorted by as many characters as the longest piece has; a binary search gives each piece's
range of suffixes, so all places where it occurs. These edges, put in order of position, are then
relaxed. A unigram model takes the path of the best total score. A byte-pair model takes, over all units
at once, the best scored edge over two neighbouring symbols of each unit, the leftmost of equals, until none is left.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame

from .common import map_batches

SPACE = "▁"
NO_CHAR = 0x110000
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Characters that are indexed at once, and units a process remembers.
BATCH_CHARS, MOST_UNITS = 400_000, 300_000
#: A unit of more characters is merged through a heap; others, all at once, by a merge a pass.
LONG_UNIT = 256


@dataclass
class Model:
    pieces: list[str]
    codes: np.ndarray
    score: np.ndarray
    ids: np.ndarray
    rank: np.ndarray  # of equal scores equal; the best has the highest
    bytes_: np.ndarray  # id of each byte's piece, or -1
    unknown: int
    longest: int
    by_unit: bool


@cache
def load(name: str) -> Model:
    """The normal pieces of a model file without normalisation, as the byte-pair models with byte fallback have it."""
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    pieces = [sp.id_to_piece(i) for i in normal]
    score = np.array([sp.get_score(i) for i in normal])
    longest = max(map(len, pieces))
    codes = np.array([[*map(ord, p), *[NO_CHAR] * (longest - len(p))] for p in pieces], np.uint32)
    byte_ids = np.full(256, -1)
    for b in range(256):
        i = sp.piece_to_id(f"<0x{b:02X}>")
        if sp.is_byte(i):
            byte_ids[b] = i
    return Model(pieces, codes, score, np.array(normal), np.unique(score, return_inverse=True)[1] + 1, byte_ids, sp.unk_id(), longest, not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces))


def edges(codes: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, length, 1 + the piece's number) of every place in `codes` where a piece occurs, in order of position, then length."""
    n, depth = len(codes), model.longest
    known, rank = np.unique(codes, return_inverse=True)
    bits = max(1, int(len(known)).bit_length())
    per = 63 // bits
    padded = np.concatenate([rank + 1, np.zeros(depth, np.int64)]).astype(np.uint64)
    keys = []
    for begin in range(0, depth, per):
        key = np.zeros(n, np.uint64)
        for i in range(begin, begin + per):
            key = key << np.uint64(bits) | (padded[i : i + n] if i < depth else np.uint64(0))
        keys.append(key)
    order = np.lexsort(keys[::-1]) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    keys = [k[order] for k in keys]
    spelt = model.codes  # a row per piece, filled up with NO_CHAR
    at = np.minimum(np.searchsorted(known, spelt), len(known) - 1)
    used = spelt != NO_CHAR
    ok = np.flatnonzero(((known[at] == spelt) | ~used).all(axis=1) & used[:, 1])
    if not len(ok):
        return (np.empty(0, np.int64),) * 3
    size = used[ok].sum(axis=1)
    number = np.where(used, at + 1, 0)[ok].astype(np.uint64)
    low = np.zeros((len(ok), len(keys)), np.uint64)
    high = np.zeros((len(ok), len(keys)), np.uint64)
    for i in range(len(keys) * per):
        x = number[:, i] if i < depth else np.zeros(len(ok), np.uint64)
        j, full = i // per, np.uint64((1 << bits) - 1)
        low[:, j] = low[:, j] << np.uint64(bits) | x
        high[:, j] = high[:, j] << np.uint64(bits) | np.where(i < size, x, full)
    lo, hi = np.searchsorted(keys[0], low[:, 0], "left"), np.searchsorted(keys[0], high[:, 0], "right")
    for r in np.flatnonzero((hi > lo) & (size > per)):
        a, b = int(lo[r]), int(hi[r])
        for j in range(1, len(keys)):
            if size[r] <= j * per:
                break
            a, b = a + int(np.searchsorted(keys[j][a:b], low[r, j], "left")), a + int(np.searchsorted(keys[j][a:b], high[r, j], "right"))
        lo[r], hi[r] = a, max(a, b)
    count = hi - lo
    start = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    place = order[start + np.arange(count.sum())]
    which, length = np.repeat(ok, count), np.repeat(size, count)
    by = np.argsort(place * (depth + 1) + length)
    return place[by], length[by], which[by] + 1


def edge_table(codes: np.ndarray, model: Model) -> np.ndarray:
    """table[p, n]: 1 + the number of the piece of n characters at position p, else 0; from edges() of BATCH_CHARS positions at a time."""
    table = np.zeros((len(codes), model.longest + 1), np.int32)
    for at in range(0, len(codes), BATCH_CHARS):
        place, length, number = edges(codes[at : at + BATCH_CHARS + model.longest - 1], model)
        own = slice(0, np.searchsorted(place, BATCH_CHARS))
        table[at + place[own], length[own]] = number[own]
    return table


def merged(codes: np.ndarray, first: np.ndarray, table: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte-pair merging of all units at once: (start, length, unit) of the symbols left. first: where each unit begins."""
    n, depth = len(codes), table.shape[1] - 1
    rank = np.concatenate([[0], model.rank])
    begin = np.arange(n)
    unit = np.searchsorted(first, begin, "right") - 1
    size = np.ones(n, np.int64)
    done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        both = size[:-1] + size[1:]
        fits = (unit[:-1] == unit[1:]) & (both <= depth)
        value = np.concatenate([np.where(fits, rank[table[begin[:-1], np.minimum(both, depth)]], 0), [0]])
        starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        top = np.maximum.reduceat(value, starts)
        per = np.repeat(top, np.diff(np.concatenate([starts, [len(begin)]])))
        live = per > 0
        if not live.all():
            done.append((begin[~live], size[~live], unit[~live]))
            begin, size, unit, value, per = begin[live], size[live], unit[live], value[live], per[live]
            if not len(begin):
                break
        at = np.flatnonzero(value == per)
        at = at[np.concatenate([[True], unit[at][1:] != unit[at][:-1]])]
        size[at] += size[at + 1]
        keep = np.ones(len(begin), bool)
        keep[at + 1] = False
        begin, size, unit = begin[keep], size[keep], unit[keep]
    start, length, unit = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.empty(0, np.int64),) * 3
    order = np.argsort(start)
    return start[order], length[order], unit[order]


def merged_long(table: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As merged() for one long unit: a heap holds the edges over two neighbouring symbols, so time is n log n in its characters."""
    n, depth = len(table), table.shape[1] - 1
    rank = [0, *model.rank.tolist()]
    size, before = [1] * n, list(range(-1, n))
    pair = table[:-1, 2]
    heap = [(-rank[k], p, 1, 1) for p, k in zip(np.flatnonzero(pair).tolist(), pair[pair > 0].tolist(), strict=True)]
    heapify(heap)

    def offer(p: int, q: int) -> None:
        both = size[p] + size[q]
        if both <= depth and (k := table[p, both]):
            heappush(heap, (-rank[k], p, size[p], size[q]))

    while heap:
        _, p, a, b = heappop(heap)
        q = p + a
        if size[p] != a or q >= n or size[q] != b:
            continue  # one of the two was merged since
        size[p], size[q] = a + b, 0
        before[q + b] = p
        if before[p] >= 0:
            offer(before[p], p)
        if q + b < n:
            offer(p, q + b)
    length = np.array(size)
    start = np.flatnonzero(length)
    return start, length[start], np.zeros(len(start), np.int64)


def best_path(codes: np.ndarray, first: np.ndarray, table: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unigram: the path of the best total score in each unit, by relaxing edges in order of position. As merged()."""
    n, depth = len(codes), table.shape[1] - 1
    unknown = float(model.score.min()) - 10
    single = {p: model.score[i] for i, p in enumerate(model.pieces) if len(p) == 1}
    out: list[tuple[int, int, int]] = []
    for u, (a, b) in enumerate(zip(first, [*first[1:], n], strict=True)):
        best, back = [0.0] + [-np.inf] * (b - a), [0] * (b - a + 1)
        for p in range(b - a):
            for m in range(1, min(depth, b - a - p) + 1):
                k = table[a + p, m]
                if m == 1 or k:
                    s = best[p] + (single.get(chr(codes[a + p]), unknown) if m == 1 else model.score[k - 1])
                    if s > best[p + m]:
                        best[p + m], back[p + m] = s, m
        p, path = b - a, []
        while p:
            path.append((a + p - back[p], back[p], u))
            p -= back[p]
        out += path[::-1]
    return tuple(np.array(x, dtype=np.int64) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def encode_units(units: list[str], name: str, unigram: bool = False) -> list[bytes]:
    """Each unit's ids as little-endian 32-bit numbers."""
    model = load(name)
    text = "".join(units)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return [b""] * len(units)
    first = np.cumsum([0] + [len(u) for u in units])[:-1]
    table = edge_table(codes, model)
    if unigram or len(units) > 1 or len(codes) <= LONG_UNIT:
        start, length, unit = (best_path if unigram else merged)(codes, first, table, model)
    else:
        start, length, unit = merged_long(table, model)
    piece = table[start, length]
    ids = np.where(piece > 0, model.ids[np.maximum(piece, 1) - 1], -1)
    lone = np.flatnonzero(ids < 0)  # one character each
    chars, which = np.unique(codes[start[lone]], return_inverse=True)
    spelt = [_singles(name)(chr(c)) for c in chars.tolist()]
    count = np.ones(len(ids), np.int64)
    if len(lone):
        count[lone] = np.array([len(x) for x in spelt])[which]
        ids[lone] = np.array([x[0] for x in spelt])[which]
    end = np.cumsum(count)
    flat = np.repeat(ids, count).astype("<u4")
    for i, k in zip(lone.tolist(), which.tolist(), strict=True) if max(map(len, spelt), default=1) > 1 else ():
        if count[i] > 1:
            flat[end[i] - count[i] : end[i]] = spelt[k]
    raw = flat.tobytes()
    stop = (4 * np.cumsum(np.bincount(unit, count, len(units)))).astype(np.int64).tolist()
    return [raw[a:b] for a, b in zip([0, *stop[:-1]], stop, strict=True)]


@cache
def _singles(name: str):
    """Ids of one character: its piece, else its bytes, else the unknown id."""
    model = load(name)
    known = {p: [int(model.ids[i])] for i, p in enumerate(model.pieces) if len(p) == 1}

    def ids(c: str) -> list[int]:
        got = known.get(c)
        if got is None:
            raw = model.bytes_[list(c.encode("utf-8", "surrogatepass"))].tolist()
            got = known[c] = raw if min(raw) >= 0 else [model.unknown]
        return got

    return ids


_known: dict[tuple[str, bool], dict[str, bytes]] = {}


def encode_batch(texts: list[str | None], name: str, unigram: bool = False) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers. Units met before are remembered, but for long ones.

    A unit longer than LONG_UNIT is encoded by itself, in about 200 bytes a character.
    """
    known = _known.setdefault((name, unigram), {})
    if len(known) > MOST_UNITS:
        known.clear()
    split = [units_of(t, name) for t in texts]
    new: list[str] = list(dict.fromkeys(u for us in split for u in us if u not in known))
    long_ = {u: encode_units([u], name, unigram)[0] for u in new if len(u) > LONG_UNIT}
    new = [u for u in new if len(u) <= LONG_UNIT]
    at = 0
    while at < len(new):
        size, end = 0, at
        while end < len(new) and (end == at or size + len(new[end]) <= BATCH_CHARS):
            size += len(new[end])
            end += 1
        known.update(zip(new[at:end], encode_units(new[at:end], name, unigram), strict=True))
        at = end
    if long_:
        return [b"".join([long_[u] if u in long_ else known[u] for u in us]) for us in split]
    return [b"".join(map(known.__getitem__, us)) for us in split]


def units_of(text: str | None, name: str) -> list[str]:
    if not text:
        return []
    if load(name).by_unit:
        if "  " not in text and SPACE not in text and text[0] != " ":
            return (SPACE + text.replace(" ", f" {SPACE}")).split(" ")
        return _UNIT.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + text.replace(" ", SPACE)]


@cache
def _spelling(name: str) -> tuple[list[bytes], ...]:
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    out = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        out.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode())
    return (out,)


def decode(ids: bytes, name: str) -> str:
    """The text of ids: pieces' characters, byte pieces put together as UTF-8, without the leading space that encoding adds."""
    spelling = _spelling(name)[0]
    text = b"".join([spelling[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def encode_documents(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_equal: one row per input row, from whole texts.

    ids_crc32 is that of the ids as little-endian unsigned 32-bit numbers; decoded_equal says whether decoding
    gives the text back (a text with the character U+2581, which means a space, can't). Null and empty
    texts have no piece. A null doc_id stays null; repeated rows each give a row; an empty table
    gives none; other columns are ignored. Map-only.
    """

    def run(rows: list[list]):
        ids, texts = rows
        at = 0
        while at < len(ids):
            end, size = at, 0
            while end < len(ids) and (end == at or size < 10 * BATCH_CHARS):
                size += len(texts[end] or "")
                end += 1
            for doc_id, text, got in zip(ids[at:end], texts[at:end], encode_batch(texts[at:end], name), strict=True):
                yield doc_id, len(got) // 4, zlib.crc32(got), decode(got, name) == (text or "")
            at = end

    return map_batches(docs, run, "doc_id long, n_pieces long, ids_crc32 long, decoded_equal boolean", ["doc_id", "text"])
