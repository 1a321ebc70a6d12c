"""Operator 2: language-model scores by online logistic context mixing.

A text is its tokens: words (A-Z lower-cased), then one end. Every token of the
training texts has a binary code, and a text is coded bit by bit. Three
predictors give each bit a probability from hashed contexts that reach over
word borders: none (how often tokens of a class occur), the token before, and the two
tokens before, each with the bits of the code so far. Their counters cover the
whole training corpus. Their logits are mixed by weights that a gate selects
(how much evidence the contexts have, and whether they are certain), and the mix is
refined by an adaptive probability map. ``score`` is the log10 of the
probability of the whole text, ``bits_per_byte`` the same per byte (words with a space between).

The code: tokens fall into classes by the power of two of their count. A class has a
Shannon code by its share of all tokens, and a token the code of its
class and its rank inside it, so a token costs about the bits of its frequency
before any context is known. A token that no training text has takes the code of an escape (which weighs
as much as all tokens seen once), and is then spelled in bytes, whose
bits are predicted from the 1 and 3 bytes before, mixed by the same machinery; the words of the shard are
counted in order of hash, and weights learned from those that occur once.

Learning is online: a shard codes its contexts one segment
after the other, in order, and after each moves weights and map by the training occurrences in it. Shards are as many as the
bytes of training texts ask for and segments end by training contexts alone, so texts that are held out change no other score.
What is learned takes away the occurrence that is coded, so weights learn how far
counters are right about text not seen yet. What coding costs so is ``fresh_bits_per_byte``:
of a training text, the cost of its tokens as if each was new, by which texts that occur
again stand apart. Held-out texts are fresh anyway.

1. Vocabulary: groups of text tell shards their distinct tokens; a shard is a
   range of token hashes. Class sizes are summed by windows, so ranks need no task that sees all tokens.
2. Contexts: groups ask for their distinct (token before the last, last, token);
   a shard is a range of hashes of the last token, so it holds all that follows the token. Tokens with more
   than SPLIT occurrences are dealt out by the token before as well, into as many contexts as needed, and pairs
   that may occur more than SPLIT_PAIRS times by the group too; no shard gathers all of a frequent token.
3. Answers come back to the groups, which add them up by text.

Each part of a frequent token counts what follows it alone, so its counters are those of a part of the corpus; so do the parts
of a pair. Shards depend on the data alone (their number on the bytes of training text), so scores do not depend on the
number of partitions or tasks. Messages are packed arrays, at most one for each token or context that a group has.

base is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over tokens: words and one end for each text.
Null texts have the end alone. A null id counts as the empty text for the
held-out rule. Repeated rows are learned and scored each. Without
training texts N and V are 0 and every word is spelled. Columns other than id and text are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracklens.llm.packed import pack, pack_bits, runs, unpack, unpack_bits
from tracklens.llm.spark import GROUP_BYTES, cut, grouped
from tracklens.llm.words import U64, Hasher, hash_ranges, join, mix, slices

LAST_BITS, BOTH_BITS = 36, 20  # of a message key: what tells the last token, and what tells both tokens before
SPLIT, SPLIT_PAIRS = 1 << 16, 1 << 26
BATCH = 8192  # bytes of words spelled between two steps of the weights
SEGMENT, WARM = 1 << 14, 8  # contexts coded between two steps of the weights, and steps on the first of them before coding begins
TELL_BYTES = 4 << 20  # of distinct words that a task holds before it tells them
CLASSES, ESCAPE = 64, 63
GRAIN = 128  # costs are told in such parts of a bit
RATE, PRIOR = 0.25, 0.4
BINS = 29
_WORD = Hasher(404, True)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
END = b"\n"
_END_HASH = U64(0x00C0FFEE00C0FFEE)


def is_held_out(row_id: int | None) -> bool:
    return zlib.crc32(b"" if row_id is None else str(row_id).encode()) % 10 == 0


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    end = np.cumsum(size)
    return data[np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)]


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, which one each value is); hashed first, so only distinct values are sorted."""
    coded = pa.array(h.view(np.int64)).dictionary_encode()
    of, values = coded.indices.to_numpy(), coded.dictionary.to_numpy().view(U64)
    order = np.argsort(values)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    of = rank[of]
    first = np.empty(len(order), np.int64)
    first[of] = np.arange(len(of))
    return values[order], first, of


def _by_code(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The order of (group, code); groups are small numbers and codes short enough for one integer, or else two sorts are made."""
    if len(code) and int(group.max()) < 1 << 20 and not (code & U64((1 << 20) - 1)).any():
        return np.argsort((group.astype(U64) << U64(44)) | (code >> U64(20)))
    return np.lexsort((code, group))


def _cuts(sorted_keys: np.ndarray, shards: int) -> Iterator[tuple[int, int, int]]:
    """(shard, from, to) of each range of 64-bit keys that has any."""
    shard = _shard(sorted_keys, shards)
    at, _ = runs(shard)
    for i, j in zip(at, [*at[1:], len(shard)], strict=True):
        yield int(shard[i]), int(i), int(j)


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


# tokens of a group


class Lexicon:
    """Tokens of a group of texts in order, and its distinct tokens by hash; the end is one of them."""

    def __init__(self, t: pa.Table, bytes_too: bool = False):
        ids = t.column("id").to_pylist()
        self.train = np.array([not is_held_out(i) for i in ids], bool)
        self.docs = len(ids)
        h, size, doc, raw = [], [], [], []
        for s in slices(t.column("text")):
            h.append(s.hashes(_WORD))
            size.append(s.end - s.start)
            doc.append(s.doc + s.at)
            if bytes_too:
                raw.append(_FOLD[_gather(s.data, s.start, size[-1])])
        cat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        h, size, doc = cat(h, U64), cat(size, np.int64), cat(doc, np.int64)
        self.length = np.bincount(doc, minlength=self.docs) + 1
        self.doc = np.repeat(np.arange(self.docs), self.length)
        word = np.ones(len(self.doc), bool)
        word[np.cumsum(self.length) - 1] = False
        every = np.full(len(word), _END_HASH)
        every[word] = h
        self.h, first, self.token = _distinct(every)
        self.count = np.bincount(self.token, weights=self.train[self.doc], minlength=len(self.h)).astype(np.int64)
        wide = np.ones(len(word), np.int64)
        wide[word] = size
        self.size = wide[first]
        if bytes_too:
            all_ = np.full(int(wide.sum()), END[0], np.uint8)
            all_[np.repeat(word, wide)] = cat(raw, np.uint8)
            self.raw = _gather(all_, (np.cumsum(wide) - wide)[first], self.size)

    def before(self, tokens: np.ndarray) -> np.ndarray:
        """The value of the token before each; before the first of a text stands the end."""
        out = np.empty_like(tokens)
        out[1:] = tokens[:-1]
        out[np.cumsum(self.length) - self.length] = self.end
        return out

    @property
    def end(self) -> int:
        return int(np.searchsorted(self.h, _END_HASH))


class Contexts:
    """The distinct (token before the last, last, token) of a group, in order of (key, token); counts: of its tokens in the whole corpus."""

    def __init__(self, x: Lexicon, counts: np.ndarray, group: int):
        last = x.before(x.token)
        second = x.before(last)
        one, two = x.h[last], x.h[second]
        parts = (counts[last] // SPLIT + 1).astype(U64)
        some = np.minimum(counts[last], counts[second]) // SPLIT_PAIRS + 1
        deal = mix(two + (U64(group) % some.astype(U64)) * U64(0x9E3779B97F4A7C15)) % parts
        a, b = mix(one + deal * U64(0xD6E8FEB86659FD93)), join(two, one)
        key = (a >> U64(64 - LAST_BITS) << U64(64 - LAST_BITS)) | (b >> U64(64 - BOTH_BITS) << U64(64 - LAST_BITS - BOTH_BITS))
        order = np.argsort(key)
        _, run = runs(key[order])
        order = order[np.argsort(run * len(x.h) + x.token[order])]
        key, token = key[order], x.token[order]
        first, run = runs(key, token)
        self.of = np.empty(len(order), np.int64)  # the context of each token
        self.of[order] = run
        self.key, self.token = key[first], token[first]
        self.count = np.bincount(self.of, weights=x.train[x.doc], minlength=len(first)).astype(np.int64)


# the code of tokens


class Code:
    """Prefix codes of token classes, left-aligned in 64 bits, from the mass and number of tokens of each."""

    def __init__(self, mass: np.ndarray, kinds: np.ndarray):
        """mass, kinds: by class; the escape has kinds 1."""
        have = np.flatnonzero(mass > 0)
        share = mass / mass.sum()
        self.width = np.zeros(CLASSES, np.int64)  # bits of the class
        self.width[have] = np.ceil(-np.log2(share[have])).astype(np.int64)
        self.rank_bits = np.array([int(k - 1).bit_length() if k > 0 else 0 for k in kinds])
        self.start = np.zeros(CLASSES, U64)
        at = 0
        for c in sorted(have, key=lambda c: (self.width[c], c)):
            self.start[c] = at
            at += 1 << (64 - int(self.width[c])) if self.width[c] else 0
        self.length = self.width + self.rank_bits
        if self.length.max() > 53:
            raise ValueError("codes are too long")
        # what predicts the bits of the class: mass on the token's own branch against the other
        self.logit = np.zeros((int(self.width.max()) + 1, CLASSES), np.float32)
        for d in range(len(self.logit) - 1):
            for c in have[self.width[have] > d]:
                own, all_ = (sum(mass[o] for o in have if self.width[o] >= k and (int(self.start[o]) ^ int(self.start[c])) >> (64 - k) == 0) if k else mass.sum() for k in (d + 1, d))
                self.logit[d, c] = np.clip(np.log(own / max(all_ - own, 1e-9)), -12, 12)

    def of(self, count: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code, class) of tokens."""
        c = classes(count)
        shift = np.clip(64 - self.length[c], 0, 63).astype(U64)
        return self.start[c] | np.where(self.rank_bits[c] > 0, rank.astype(U64) << shift, U64(0)), c


def classes(count: np.ndarray) -> np.ndarray:
    """The power of two of a token's count; the escape's class where it is 0."""
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1] - 1, ESCAPE)


# mixing


class Mixer:
    """Gated weights over the predictors' logits, then an adaptive map. All is symmetric in the two values of a bit,
    so an event tells only how the predictors see the value that came: ``x`` are logits of that value."""

    def __init__(self, inputs: int, gates: int):
        self.w = np.full((inputs, gates), 1 / max(1, inputs - 1))
        self.hit, self.total = np.zeros(gates * BINS), np.zeros(gates * BINS)
        self.gates = gates
        self.frozen: tuple | None = None

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        if self.frozen is None:
            self.frozen = self.w.astype(np.float32), self.hit.astype(np.float32), self.total.astype(np.float32)
        z = self.frozen[0][0].take(gate) * x[0]
        for w, v in zip(self.frozen[0][1:], x[1:], strict=True):
            z += w.take(gate) * v
        return np.clip(z, -14, 14)

    def refine(self, z: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probability of the value that came, the same before the map, its bin in the map)."""
        size = np.abs(z)
        at = gate * BINS + np.rint(size * 2).astype(np.int32)
        p = 1 / (1 + np.exp(-size))
        better = np.clip(0.5 * p + 0.5 * (self.frozen[1].take(at) + 8 * p) / (self.frozen[2].take(at) + 8), 1e-7, 1 - 1e-7)
        up = z > 0
        return np.where(up, better, np.where(z < 0, 1 - better, np.float32(0.5))), np.where(up, p, 1 - p), at

    def learn(self, x: list[np.ndarray], gate: np.ndarray, z: np.ndarray, p: np.ndarray, at: np.ndarray, weight: np.ndarray, map_too: bool = True) -> None:
        err = (1 - p) * weight
        curve = err * p
        for w, v in zip(self.w, x, strict=True):
            up, down = np.bincount(gate, err * v, self.gates), np.bincount(gate, curve * v * v, self.gates)
            w += RATE * np.clip(up / (down + 4), -2, 2)
        self.frozen = None
        if not map_too:
            return
        self.hit += np.bincount(at, weight * ((z > 0) + np.float32(0.5) * (z == 0)), len(self.hit))
        self.total += np.bincount(at, weight, len(self.total))


_LOGS = np.log(np.arange(1 << 12) + PRIOR).astype(np.float32)


def _log(n: np.ndarray) -> np.ndarray:
    if len(n) and n.max() >= len(_LOGS):
        return np.log(n + PRIOR).astype(np.float32)
    return _LOGS.take(n)


def _lean(own: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _log(own) - _log(other)


_STEPS = np.array([0, 1, 2, 3, 3, 4, 4, 4, 4, 5, 5, 5, 5, 5, 5, 5, 5, 6], np.int32)


def _steps(n: np.ndarray) -> np.ndarray:
    """0, 1, 2, 3-4, 5-8, 9-16, more."""
    return _STEPS.take(np.minimum(n, 17))


def _common(code: np.ndarray, same: np.ndarray) -> np.ndarray:
    """How many first bits each code shares with the one before it; -1 where the context is another."""
    out = np.full(len(code), -1)
    out[1:] = np.where(same[1:], 64 - np.frexp((code[1:] ^ code[:-1]).astype(np.float64))[1], -1)
    return out


def _along(common: np.ndarray, count: np.ndarray, depths: int) -> np.ndarray:
    """By depth: how many occurrences of the context share so many bits of each code. Codes of a context stand in order; one that
    shares so many bits with no neighbour has its own occurrences alone."""
    out = np.empty((depths, len(count)), np.int32 if count.sum() < 1 << 31 else np.int64)
    out[:] = count
    until = np.maximum(common, np.append(common[1:], -1))
    i = np.flatnonzero(until >= 0)
    for d in range(depths):
        i = i[until[i] >= d]
        if not len(i):
            break
        new = common[i] < d
        out[d, i] = np.add.reduceat(count[i], np.flatnonzero(new))[np.cumsum(new) - 1]
    return out


class Segment:
    """Some contexts, all that the last token of each has; in order of (key, code).

    From the bit on at which no other token of the last token's followers shares the code, counters stay
    as they are, so the bits of the rank behind it are one event, as often as there are bits.
    """

    def __init__(self, key: np.ndarray, code: np.ndarray, kind: np.ndarray, count: np.ndarray, book: Code):
        self.book, self.kind, n = book, kind, len(key)
        a = key >> U64(64 - LAST_BITS)
        order = _by_code(runs(a)[1], code)
        at, run = runs(a[order], code[order])
        one_a, one_code = a[order][at], code[order][at]
        common = _common(one_code, np.concatenate([[False], one_a[1:] == one_a[:-1]]))
        self.pair = np.empty(n, np.int64)
        self.pair[order] = run
        alone = np.maximum(common, np.append(common[1:], -1))[self.pair] + 1
        length = book.length[kind]
        self.single = np.minimum(np.maximum(alone, book.width[kind]), length)  # bits that are events of their own
        self.rest = length - self.single
        self.depths = int((self.single + (self.rest > 0)).max()) + 1
        self.two = _along(_common(code, np.concatenate([[False], key[1:] == key[:-1]])), count, self.depths)
        self.one = _along(common, np.add.reduceat(count[order], at), self.depths)

    def bits(self) -> Bits:
        """The events of all contexts."""
        single, rest, book = self.single, self.rest, self.book
        d, c = np.nonzero(np.arange(self.depths - 1)[:, None] < (single + (rest > 0))[None, :])
        kind = self.kind.take(c)
        at, pair = d * len(self.kind) + c, d * self.one.shape[1] + self.pair.take(c)
        two, one = self.two.reshape(-1), self.one.reshape(-1)
        many = np.where(d == single.take(c), rest.take(c), 1).astype(np.float32)
        place = np.minimum(d, len(book.logit) - 1) * CLASSES + kind
        return Bits(c, many, two.take(at), two.take(at + len(self.kind)), one.take(pair), one.take(pair + self.one.shape[1]), place, book.logit.reshape(-1).take(place), d < book.width.take(kind))


@dataclass
class Bits:
    """Events: the context of each, how many bits it stands for, occurrences at its node and those with the value that came (by two tokens and by one), place and logit in the code of classes, whether it is a bit of a class."""

    context: np.ndarray
    many: np.ndarray
    all2: np.ndarray
    own2: np.ndarray
    all1: np.ndarray
    own1: np.ndarray
    place: np.ndarray
    logit: np.ndarray
    of_class: np.ndarray

    def alike(self, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which kind each event is of, an event of each kind): events of a kind have equal counters, place and told."""
        key = self.of_class.astype(np.int64) * 2 + told
        for x, k in ((self.all2, 0x9E3779B97F4A7C15), (self.own2, 0xC2B2AE3D27D4EB4F), (self.all1, 0x165667B19E3779F9), (self.own1, 0xD6E8FEB86659FD93), (self.place, 0x85EBCA77C2B2AE63)):
            key += x * np.int64(k - (1 << 64) if k >> 63 else k)
        kinds = pa.array(mix(key.view(U64)).view(np.int64)).dictionary_encode().indices.to_numpy()
        first = np.empty(int(kinds.max()) + 1, np.int64)
        first[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)
        return kinds, first

    def take(self, i: np.ndarray) -> Bits:
        return Bits(*(getattr(self, f.name)[i] for f in fields(self)))

    def inputs(self, less: np.ndarray | int) -> tuple[list[np.ndarray], np.ndarray]:
        """(logits of the value that came, gate) without so many occurrences of their own."""
        a2, o2, a1, o1 = self.all2 - less, self.own2 - less, self.all1 - less, self.own1 - less
        other2 = a2 - o2
        gate = ((_steps(a2) * 7 + _steps(a1)) * 2 + ((o2 == 0) | (other2 == 0))) * 2 + self.of_class
        return [self.logit, _lean(o1, a1 - o1), _lean(o2, other2)], gate


def code_contexts(key: np.ndarray, code: np.ndarray, kind: np.ndarray, count: np.ndarray, book: Code) -> tuple[np.ndarray, np.ndarray]:
    """(log10 of the probability, and of that without the occurrence itself) of distinct contexts in order of (key, code).

    The contexts are coded in this order, a segment with about SEGMENT contexts of training texts that ends with a last token
    at a time; weights and map move after each. Contexts that training texts lack are coded with the state of their place and
    move nothing, segment borders included. On the first segment the weights take WARM steps before coding begins. Events
    with equal counters are mixed once, weighted by their number.
    """
    fresh, score, mixer = np.zeros(len(key)), np.zeros(len(key)), Mixer(3, 7 * 7 * 2 * 2)
    ends = np.append(runs(key >> U64(64 - LAST_BITS))[0][1:], len(key))
    learned = np.cumsum(count > 0)[ends - 1] if len(key) else np.zeros(1, np.int64)  # contexts of training texts up to each end
    i = before = 0
    while i < len(key):
        left = int(learned[-1]) - before
        at_end = int(np.searchsorted(learned, before + min(SEGMENT, left))) if left else len(ends) - 1
        j, before = int(ends[at_end]), int(learned[at_end])
        some = slice(i, j)
        bits = Segment(key[some], code[some], kind[some], count[some], book).bits()
        if len(bits.context):
            told = (count[some] > 0).astype(np.int32).take(bits.context)
            of, first = bits.alike(told)
            kinds, own = bits.take(first), told[first]
            weight = np.bincount(of, count[some].astype(np.float64).take(bits.context) * bits.many, len(first)).astype(np.float32)

            def without_itself(kinds: Bits = kinds, own: np.ndarray = own) -> tuple:
                x, gate = kinds.inputs(own)
                z = mixer.mix(x, gate)
                return (x, gate, z, *mixer.refine(z, gate))

            def cost(p: np.ndarray, bits: Bits = bits, of: np.ndarray = of, n: int = j - i) -> np.ndarray:
                return np.bincount(bits.context, np.log10(p).take(of) * bits.many, n)

            for _ in range(WARM if i == 0 else 0):
                x, gate, z, _, rough, at = without_itself()
                mixer.learn(x, gate, z, rough, at, weight, map_too=False)
            x, gate = kinds.inputs(0)
            score[some] = cost(mixer.refine(mixer.mix(x, gate), gate)[0])
            x, gate, z, p, rough, at = without_itself()
            fresh[some] = cost(p)
            mixer.learn(x, gate, z, rough, at, weight)
        i = j
    return score, fresh


def parts_of_a_bit(log10: np.ndarray) -> np.ndarray:
    """Costs as whole numbers of GRAIN parts of a bit; as large as they come."""
    return np.maximum(np.rint(log10 * (-np.log2(10) * GRAIN)), 0).astype(U64)


# spelling


ORDERS, TABLE_BITS = (1, 3), (16, 21)


def _bits(raw: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(word, slots of each order for the value that came) of all bits of words, each followed by a space."""
    more = size + 1
    first = np.cumsum(more) - more
    byte = np.full(int(more.sum()), 32, np.uint8)
    byte[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(len(raw))] = raw
    word = np.repeat(np.arange(len(size)), more)
    depth = np.arange(len(byte)) - first[word]
    eight = np.arange(8, dtype=U64)
    salt = ((U64(1) << eight)[None, :] | (byte[:, None] >> (U64(8) - eight)[None, :])) * U64(0x9E3779B97F4A7C15)  # the bits so far
    bit = ((byte[:, None] >> (U64(7) - eight)[None, :]) & U64(1)).view(np.int64)
    out = []
    for k, bits in zip(ORDERS, TABLE_BITS, strict=True):
        back = np.zeros(len(byte), U64)
        for j in range(1, k + 1):
            back[j:] |= np.where(depth[j:] >= j, byte[:-j], 0).astype(U64) << U64(8 * j - 8)
        at = ((mix(back + U64(k << 40))[:, None] ^ salt) * U64(0xD6E8FEB86659FD93) >> U64(64 - bits)).view(np.int64)
        out.append((at * 2 + bit).reshape(-1))
    return np.repeat(word, 8), out


def spell(raw: np.ndarray, size: np.ndarray, count: np.ndarray) -> np.ndarray:
    """log10 of the probability that an unknown token is this one, where the count is 0; else 0. Learned from the types of the shard, see module."""
    out = np.zeros(len(size))
    unknown, known = np.flatnonzero(count == 0), np.flatnonzero(count > 0)
    if not len(unknown):
        return out
    start = np.cumsum(size) - size
    tables = [np.zeros(2 << b, np.int32) for b in TABLE_BITS]  # a shard has fewer types than that
    mixer = Mixer(len(ORDERS), 7 * 7)

    def events(some: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return _bits(_gather(raw, start[some], size[some]), size[some])

    def batches(some: np.ndarray) -> Iterator[np.ndarray]:
        group = np.cumsum(size[some] + 1) // BATCH
        yield from np.split(some, np.flatnonzero(np.diff(group)) + 1) if len(some) else ()

    def alike(slots: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """(which kind each event is of, logits and gate of each kind): events of a kind have equal counters."""
        n = [t.take(x).astype(np.int64) for t, s in zip(tables, slots, strict=True) for x in (s, s ^ 1)]
        kinds = pa.array(mix(sum(x * np.int64(k) for x, k in zip(n, (1, 0x1F123BB5159A55E5, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D), strict=True)).view(U64)).view(np.int64)).dictionary_encode().indices.to_numpy()
        first = np.zeros(int(kinds.max(initial=-1)) + 1, np.int64)
        first[kinds[::-1]] = np.arange(len(kinds) - 1, -1, -1)
        n = [x[first] for x in n]
        return kinds, [_lean(n[0], n[1]), _lean(n[2], n[3])], _steps(n[2] + n[3]) * 7 + _steps(n[0] + n[1])

    for some in batches(known):  # each batch is coded with what came before it, then counted
        word, slots = events(some)
        rare = (count[some] == 1).take(word)
        kinds, x, gate = alike([s[rare] for s in slots])
        z = mixer.mix(x, gate)
        _, rough, at = mixer.refine(z, gate)
        mixer.learn(x, gate, z, rough, at, np.bincount(kinds, minlength=len(z)).astype(np.float32))
        for t, s in zip(tables, slots, strict=True):
            np.add.at(t, s, np.ones(len(s), np.int32))  # of the same type, or it takes ten times as long
    for some in batches(unknown):
        word, slots = events(some)
        kinds, x, gate = alike(slots)
        p, *_ = mixer.refine(mixer.mix(x, gate), gate)
        out[some] = np.bincount(word, np.log10(p).take(kinds), len(some))
    return out


# the frames


def _bundles(groups: DataFrame) -> DataFrame:
    """(g, ids, has, sizes, texts): rows (g, id, text) of a batch by group, as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for b in batches:
            g = b.column(0).to_numpy()
            order = np.argsort(g, kind="stable")
            b, g = b.take(pa.array(order)), g[order]
            text = b.column(2).fill_null("").cast(pa.large_string())
            off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            raw = memoryview(text.buffers()[2] or b"")
            ids, has = b.column(1).fill_null(0).to_numpy(), b.column(1).is_valid().to_numpy(zero_copy_only=False)
            at, _ = runs(g)
            r = [(int(g[i]), pack(ids[i:j]), pack_bits(has[i:j]), pack(np.diff(off[i : j + 1])), zip_.compress(raw[off[i] : off[j]])) for i, j in zip(at, [*at[1:], len(g)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([y[k] for y in r], pa.binary() if k else pa.int32()) for k in range(5)], names=["g", "ids", "has", "sizes", "texts"])

    return groups.mapInArrow(run, "g int, ids binary, has binary, sizes binary, texts binary")


def _texts(t: pa.Table) -> pa.Table:
    """(id, text) of bundles."""
    ids, texts = [], []
    for i, h, s, x in zip(*(t.column(c).to_pylist() for c in ("ids", "has", "sizes", "texts")), strict=True):
        ids.append(pa.array(unpack(i).view(np.int64), pa.int64(), mask=~unpack_bits(h)))
        size, raw = unpack(s).astype(np.int64), zstandard.ZstdDecompressor().decompress(x)
        texts.append(pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int64).tobytes()), pa.py_buffer(raw)))
    return pa.table({"id": pa.chunked_array(ids, pa.int64()), "text": pa.chunked_array(texts, pa.large_string())})


def _zip(raw: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(raw).tobytes())


def _unzip(raw: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def _vocabulary(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(shard, h, count, size, raw, tokens, kinds, by_class): the distinct tokens of each range of hashes."""

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            step = max(1, b.num_rows * GROUP_BYTES // max(b.nbytes, GROUP_BYTES))
            for i in range(0, b.num_rows, step):
                x = Lexicon(pa.Table.from_batches([b.slice(i, step)]), bytes_too=True)
                held.append((x.h, x.count, x.size, x.raw))
                size += len(x.raw)
                if size > TELL_BYTES:
                    yield told_(merged(held))
                    held, size = [], 0
        if held:
            yield told_(merged(held))

    def told_(x: tuple) -> pa.RecordBatch:
        h, count, size, raw = x
        at = np.concatenate([[0], np.cumsum(size)])
        r = [(s, pack(count[i:j]), pack(size[i:j]), _zip(raw[at[i] : at[j]])) for s, i, j in _cuts(h, shards)]
        return pa.RecordBatch.from_arrays([pa.array([y[k] for y in r], pa.binary() if k else pa.int32()) for k in range(4)], names=["shard", "count", "size", "raw"])

    def merged(parts: list[tuple]) -> tuple:
        h, count, size, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, to = _distinct(h)
        return u, np.bincount(to, weights=count).astype(np.int64), size[first], _gather(raw, (np.cumsum(size) - size)[first], size[first])

    def gather(key: tuple, t: pa.Table) -> pa.Table:
        parts = []
        for c, s, r in zip(*(t.column(c).to_pylist() for c in ("count", "size", "raw")), strict=True):
            size, raw = unpack(s).astype(np.int64), _unzip(r, np.uint8)
            start = np.cumsum(size) - size
            h = hash_ranges(raw, start, start + size, _WORD.seed)  # of folded words
            h[(size == 1) & (raw[start] == END[0])] = _END_HASH
            parts.append((h, unpack(c).astype(np.int64), size, raw))
        h, count, size, raw = merged(parts)
        kinds = np.bincount(classes(count), minlength=CLASSES)
        mass = np.bincount(classes(count), weights=count, minlength=CLASSES).astype(np.int64)
        return _rows({
            "shard": ([key[0].as_py()], pa.int32()), "h": ([pack(h, True)], pa.binary()), "count": ([pack(count)], pa.binary()), "size": ([pack(size)], pa.binary()),
            "raw": ([_zip(raw)], pa.binary()), "kinds": ([kinds.tolist()], pa.list_(pa.int64())), "mass": ([mass.tolist()], pa.list_(pa.int64())),
        })

    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    told = d.mapInArrow(tell, "shard int, count binary, size binary, raw binary")
    return cut(told.groupBy("shard").applyInArrow(gather, "shard int, h binary, count binary, size binary, raw binary, kinds array<long>, mass array<long>"))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, fresh_bits_per_byte) of every whole text."""
    size, id_text = F.octet_length(F.col(text_col).cast("string")), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit(""))
    told = docs.agg(F.sum(size).alias("all"), F.sum(F.when(F.crc32(id_text.cast("binary")) % 10 != 0, size)).alias("train")).first()
    groups, _, _ = grouped(docs, id_col, text_col, total=told["all"] or 0)
    shards = max(1, -(-(told.train or 0) // GROUP_BYTES))
    groups = _bundles(groups)
    vocabulary = _vocabulary(docs, id_col, text_col, shards)
    by_class = vocabulary.select("shard", F.posexplode(F.arrays_zip("kinds", "mass")).alias("class", "x")).select("shard", "class", "x.kinds", "x.mass")
    sums = by_class.groupBy("class").agg(F.sum("kinds").alias("kinds"), F.sum("mass").alias("mass")).collect()  # at most CLASSES rows
    kinds, mass = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in sums:
        kinds[r["class"]], mass[r["class"]] = r.kinds, r.mass
    n, v = int(mass.sum()), int(kinds.sum() - kinds[ESCAPE])
    kinds[ESCAPE], mass[ESCAPE] = 1, max(1, int(mass[0]))
    book = Code(mass.astype(np.float64), kinds)
    ahead = F.coalesce(F.sum("kinds").over(Window.partitionBy("class").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = by_class.withColumn("ahead", ahead).groupBy(F.col("shard").alias("s")).agg(F.transform(F.sort_array(F.collect_list(F.struct("class", "ahead"))), lambda x: x["ahead"]).alias("ahead"))
    placed = vocabulary.join(ranks, F.col("shard") == F.col("s")).select("shard", "h", "count", "size", "raw", "ahead")

    def ask_tokens(key: tuple, t: pa.Table) -> pa.Table:
        x = Lexicon(_texts(t))
        r = [(s, pack(x.h[i:j], True)) for s, i, j in _cuts(x.h, shards)]
        return _rows({"g": ([key[0].as_py()] * len(r), pa.int32()), "shard": ([y[0] for y in r], pa.int32()), "h": ([y[1] for y in r], pa.binary())})

    answer_ddl = "g int, kind int, shard int, one binary, two binary, three binary"

    def answers(g: list, kind: int, shard: list, *bodies: list) -> pa.Table:
        return _rows({"g": (g, pa.int32()), "kind": ([kind] * len(g), pa.int32()), "shard": (shard, pa.int32()), **{c: (b, pa.binary()) for c, b in zip(("one", "two", "three"), bodies, strict=True)}})

    def tell_tokens(key: tuple, t: pa.Table, c: pa.Table) -> pa.Table:
        """Count, rank and spelling of the tokens that groups ask for."""
        h, count, size = unpack(c.column("h")[0].as_py(), True), unpack(c.column("count")[0].as_py()).astype(np.int64), unpack(c.column("size")[0].as_py()).astype(np.int64)
        of, ahead = classes(count), np.array(c.column("ahead")[0].as_py())
        order = np.argsort(of, kind="stable")
        at, run = runs(of[order])
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h)) - at[run] + ahead[of[order]]
        rank[of == ESCAPE] = 0
        spelled = spell(_unzip(c.column("raw")[0].as_py(), np.uint8), size, count)
        places = [np.searchsorted(h, unpack(x, True)) for x in t.column("h").to_pylist()]
        return answers(t.column("g").to_pylist(), 1, t.column("shard").to_pylist(), [pack(count[i]) for i in places], [pack(rank[i]) for i in places], [_zip(spelled[i]) for i in places])

    def known(a: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = sorted((r for r in zip(*(a.column(c).to_pylist() for c in ("kind", "shard", "one", "two", "three")), strict=True) if r[0] == 1), key=lambda r: r[1])
        cat = lambda f, k, kind: np.concatenate([f(r[k]) for r in rows] or [np.zeros(0)]).astype(kind)
        return cat(unpack, 2, np.int64), cat(unpack, 3, np.int64), cat(lambda x: _unzip(x, np.float64), 4, np.float64)

    def ask_contexts(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        x, (count, rank, _) = Lexicon(_texts(t)), known(a)
        c = Contexts(x, count, key[0].as_py())
        token = (rank << 6 | classes(count))[c.token]
        r = [(s, pack(c.key[i:j], True), pack(token[i:j]), pack(c.count[i:j])) for s, i, j in _cuts(c.key, shards)]
        return _rows({"g": ([key[0].as_py()] * len(r), pa.int32()), "shard": ([y[0] for y in r], pa.int32()), **{k: ([y[i] for y in r], pa.binary()) for i, k in ((1, "key"), (2, "token"), (3, "count"))}})

    def tell_contexts(key: tuple, t: pa.Table) -> pa.Table:
        keys = [unpack(x, True) for x in t.column("key").to_pylist()]
        each = np.cumsum([len(x) for x in keys])[:-1]
        k, token = np.concatenate(keys), np.concatenate([unpack(x) for x in t.column("token").to_pylist()])
        count = np.concatenate([unpack(x) for x in t.column("count").to_pylist()]).astype(np.int64)
        kind, rank = (token & U64(63)).astype(np.int64), (token >> U64(6)).astype(np.int64)
        code, _ = book.of(np.where(kind == ESCAPE, 0, np.left_shift(1, np.minimum(kind, 62))), rank)
        order = np.argsort(k)
        order = order[_by_code(runs(k[order])[1], code[order])]
        at, run = runs(k[order], code[order])
        of = np.empty(len(k), np.int64)
        of[order] = run
        one = order[at]
        score, fresh = code_contexts(k[one], code[one], kind[one], np.add.reduceat(count[order], at), book)
        body = lambda x: [pack(y) for y in np.split(parts_of_a_bit(x)[of], each)]
        return answers(t.column("g").to_pylist(), 2, t.column("shard").to_pylist(), body(score), body(fresh), [None] * t.num_rows)

    def finish(key: tuple, t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({f: pa.array([], k) for f, k in zip(names, kinds_out, strict=True)})
        texts = _texts(t)
        x, (count, rank, spelled) = Lexicon(texts), known(a)
        c = Contexts(x, count, key[0].as_py())
        rows = sorted((r for r in zip(*(a.column(k).to_pylist() for k in ("kind", "shard", "one", "two")), strict=True) if r[0] == 2), key=lambda r: r[1])
        score, fresh = (np.concatenate([unpack(r[k]) for r in rows]).astype(np.float64)[c.of] / (-np.log2(10) * GRAIN) + spelled[x.token] for k in (2, 3))
        sum_of = lambda y: np.bincount(x.doc, weights=y, minlength=x.docs)
        base = np.log10((count + 0.1) / (n + 0.1 * (v + 1)))
        size = sum_of(x.size[x.token] + 1.0) - 1
        score, fresh = sum_of(score), sum_of(fresh)
        bits = -np.log2(10) / size
        return pa.table(dict(zip(names, [
            texts.column("id"), pa.array(~x.train), pa.array(x.length, pa.int64()), pa.array(np.rint(sum_of((count > 0)[x.token] * 1.0)).astype(np.int64)),
            pa.array(np.full(x.docs, n), pa.int64()), pa.array(sum_of(base[x.token])), pa.array(score), pa.array(score * bits), pa.array(np.where(x.train, fresh, score) * bits),
        ], strict=True)))

    names = [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte", "fresh_bits_per_byte"]
    kinds_out = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
    asked = groups.groupBy("g").applyInArrow(ask_tokens, "g int, shard int, h binary")
    tokens = asked.groupBy("shard").cogroup(placed.groupBy("shard")).applyInArrow(tell_tokens, answer_ddl)
    wanted = groups.groupBy("g").cogroup(tokens.groupBy("g")).applyInArrow(ask_contexts, "g int, shard int, key binary, token binary, count binary")
    contexts = wanted.groupBy("shard").applyInArrow(tell_contexts, answer_ddl)
    out = groups.groupBy("g").cogroup(tokens.unionByName(contexts).groupBy("g")).applyInArrow(finish, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double, fresh_bits_per_byte double")
    return out
