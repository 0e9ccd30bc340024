"""Language-model scores by logistic mixing of hashed-context bit predictors over the token stream.

A token is coded by a few binary decisions, the path to its symbol in a prefix-code tree: the most
frequent words and the end have symbols of their own, other words share one by their last letters.
For each decision six predictors, counters found by a hash of the tree node and of a context (the
words before: their symbols, one, two and three of them, a sentence's start), give an opinion; a
gate, chosen by how much is known in two of the contexts, picks the weights that mix them in the
logistic domain, and an adaptive probability map refines the mixture. Every training text is
visited token by token: a decision is predicted, the weights learn from it, then it is counted.

Which word of a shared symbol it is, exact word counts say: a known word gets its discounted share
of the symbol, and the mass set free goes to a model of spelling, which is built in the same way
from the bits of letters and learns from every distinct word.

Texts are dealt by contents into teams of bounded size, sorted, and learned from one by one;
counters and the map are sums, weights are averaged in the order of teams, so neither cores nor
the layout of the input change a score.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertlake.llm.common import SPACES, let_go, materialize, raw, release, remainder, text_bytes

BLOCK_BYTES = 8 << 20
PART_BYTES = 16 << 20      # bytes of corpus per part of the vocabulary
SLOT_BITS = 20             # counters of a context: 2 ** SLOT_BITS, whatever the corpus
CONTEXTS = 6               # place, and the last 1, 2, 3, 4 bytes, and all bytes of the word so far
CHUNK = 2000               # words coded at a time
PRIOR, LOW = 0.4, 2.0**-16
GATES, STEPS = (7, 4), 33  # levels of knowledge; points of the map between logits -8 and 8
DISCOUNT = 0.75
TEAM_BYTES = 32 << 20      # bytes of corpus that one set of counters learns from before it is added to the others
SEGMENTS = 8               # pieces in which the counters of a context are added up
STREAM = 8192              # tokens predicted, learned from and counted at a time
TOP, KINDS = 128, 32       # words with symbols of their own; symbols of the others
END_HASH = np.uint64(1)
IS_SPACE = np.isin(np.arange(256), list(SPACES.encode()))
IS_STOP = np.isin(np.arange(256), list(b".!?"))
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
RECENT = 0.1               # share of the words seen before in the same text in a token's prediction
END = b"\n"                # white space, so never inside a word


def tokens(text: str | None) -> list[bytes]:
    """Lower-case words and the end token."""
    return [*raw(text).lower().split(), END]


# --- bits ----------------------------------------------------------------------

def coded(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots [contexts, symbols, 8], bits [symbols, 8], word number of each symbol).

    A word is coded as its bytes and a space, the end token as one line feed: no code begins another.
    """
    codes = [w if w == END else w + b" " for w in words]
    size = np.array([len(c) for c in codes], dtype=np.int64)
    flat = np.frombuffer(b"".join(codes), np.uint8)
    which = np.repeat(np.arange(len(words)), size)
    first = (np.cumsum(size) - size)[which]
    place = np.arange(len(flat)) - first
    lead = np.uint32(1)
    symbol = flat.astype(np.uint32)
    back = []
    for k in range(1, 5):
        earlier = np.concatenate([np.zeros(k, np.uint32), symbol[:-k]])[: len(symbol)]
        back.append(np.where(place >= k, earlier, np.where(place == k - 1, lead, np.uint32(0))))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()) + 1, np.uint64(0x9E3779B97F4A7C15)))
        term = np.concatenate([[np.uint64(0)], np.cumsum((symbol.astype(np.uint64) + np.uint64(1)) * power[place])])
        whole = (term[:-1] - term[first]) * np.uint64(0xC2B2AE3D27D4EB4F)
        whole = ((whole ^ (whole >> np.uint64(31))) >> np.uint64(20)).astype(np.uint32) + lead * np.uint32(0x85EBCA6B)
        three = back[0] | back[1] << np.uint32(8) | back[2] << np.uint32(16)
        context = np.stack([
            lead * np.uint32(4) + np.minimum(place, 3).astype(np.uint32), back[0], back[0] | back[1] << np.uint32(8),
            three, three * np.uint32(0x2C1B3C6D) + back[3] * np.uint32(0x297A2D39), whole])
        context = (context + np.arange(1, CONTEXTS + 1, dtype=np.uint32)[:, None] * np.uint32(0x61C88647)) * np.uint32(0x9E3779B1)
        context ^= context >> np.uint32(15)
        shift = np.arange(8, dtype=np.uint32)
        node = (np.uint32(1) << shift)[None, :] | symbol[:, None] >> (np.uint32(8) - shift)[None, :]
        node *= np.uint32(0x2545F491)
        slots = np.empty((CONTEXTS, *node.shape), np.uint32)
        for k in range(CONTEXTS):  # one at a time, so that it stays in the cache
            mixed = slots[k]
            np.add(context[k][:, None], node, out=mixed)
            mixed *= np.uint32(0x85EBCA77)
            mixed ^= mixed >> np.uint32(13)
            mixed *= np.uint32(0xC2B2AE3D)
            mixed >>= np.uint32(32 - SLOT_BITS)
    bits = (symbol[:, None] >> (np.uint32(7) - shift)[None, :]) & np.uint32(1)
    return slots, bits.astype(np.uint8), which


def fresh_counters() -> np.ndarray:
    return np.zeros((CONTEXTS, 2 << SLOT_BITS), np.float32)


def weight_of(counts: np.ndarray) -> np.ndarray:
    """How much a word teaches: slowly growing, as what it must predict are mostly new words."""
    return np.log2(1.0 + counts).astype(np.float32)


def count_bits(counters: np.ndarray, words: list[bytes], counts: np.ndarray) -> None:
    slots, bits, which = coded(words)
    weight = np.repeat(weight_of(counts)[which], 8)
    for k in range(CONTEXTS):
        np.add.at(counters[k], (slots[k].ravel() << np.uint32(1)) + bits.ravel(), weight)


def opinions(counters: np.ndarray, slots: np.ndarray, bits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(logits [contexts, n], gate [n]) of all bits; ``own`` is taken off the counter of the true bit."""
    y = bits.ravel()
    own = np.stack([np.where(y == 0, own, 0), np.where(y == 1, own, 0)], axis=1)
    logits, known = np.empty((CONTEXTS, y.size), np.float32), {}
    for k in range(CONTEXTS):
        pair = counters[k].view(np.uint64).take(slots[k].ravel().astype(np.int64), mode="clip").view(np.float32).reshape(-1, 2)
        pair = np.maximum(pair - own, 0)
        n0, n1 = pair[:, 0], pair[:, 1]
        logits[k] = np.log((n1 + np.float32(PRIOR)) / (n0 + np.float32(PRIOR)))
        if k in (3, CONTEXTS - 1):
            known[k] = n0 + n1
    return logits, _gate(known[CONTEXTS - 1], known[3])


def _gate(whole: np.ndarray, three: np.ndarray) -> np.ndarray:
    """How often the whole spelling and the last three bytes were seen."""
    level = np.minimum(np.log2(whole + 1), GATES[0] - 1).astype(np.int64) * GATES[1]
    return level + np.minimum(np.log2(three + 1) / 2, GATES[1] - 1).astype(np.int64)


def mix(logits: np.ndarray | list[np.ndarray], gate: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted sum of the logits of each context."""
    out = np.zeros(len(gate), np.float32)
    for k in range(CONTEXTS):
        out += np.ascontiguousarray(weights[:, k]).take(gate) * logits[k]
    return np.clip(out, -12, 12)


def on_map(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower point, share of the upper point) on the probability map."""
    x = (np.clip(logit, -8, 7.999) + 8) * ((STEPS - 1) / 16)
    low = x.astype(np.int64)
    return low, x - low


def learn(counters: np.ndarray, weights: np.ndarray, squares: np.ndarray, seen: np.ndarray, words: list[bytes], counts: np.ndarray,
          rate: float = 0.02) -> float:
    """One online step over ``words``: mixing weights (in place) and the map's sums; returns the weight of what was seen."""
    slots, bits, which = coded(words)
    own = np.repeat(weight_of(counts)[which], 8)
    logits, gate = opinions(counters, slots, bits, own)
    total, y = mix(logits, gate, weights), bits.ravel()
    error = own * (y - 1 / (1 + np.exp(-total)))
    size = np.maximum(np.bincount(gate, own, len(weights)), 1e-9)
    for k in range(CONTEXTS):
        g = np.bincount(gate, error * logits[k], len(weights)) / size
        squares[:, k] += g * g
        weights[:, k] += np.where(g == 0, 0, rate * g / np.sqrt(squares[:, k] + 1e-8))
    low, up = on_map(total)
    level = gate // GATES[1]
    for point, share in ((low, 1 - up), (low + 1, up)):
        at = (level * STEPS + point) * 2 + y
        seen += np.bincount(at, own * share, len(seen))
    return float(own.sum())


def word_bits(counters: np.ndarray, weights: np.ndarray, curve: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log2 probability of each word; the counters become logits once for all of them."""
    pairs, out = counters.reshape(CONTEXTS, -1, 2), [np.zeros(0)]
    table = [np.log((n[:, 1] + np.float32(PRIOR)) / (n[:, 0] + np.float32(PRIOR))) for n in pairs]
    seen = {k: pairs[k].sum(axis=1) for k in (3, CONTEXTS - 1)}
    for s in range(0, len(words), CHUNK):
        slots, bits, which = coded(words[s:s + CHUNK])
        at = [slots[k].ravel().astype(np.int64) for k in range(CONTEXTS)]
        gate = _gate(*(seen[k].take(at[k], mode="clip") for k in (CONTEXTS - 1, 3)))
        total = mix([x.take(a, mode="clip") for x, a in zip(table, at)], gate, weights)
        low, up = on_map(total)
        level = gate // GATES[1] * STEPS
        refined = curve[level + low] * (1 - up) + curve[level + low + 1] * up
        p = np.clip((1 / (1 + np.exp(-total)) + refined) / 2, LOW, 1 - LOW)
        cost = np.log2(np.where(bits.ravel() == 1, p, 1 - p).astype(np.float64)).reshape(-1, 8).sum(axis=1)
        out.append(np.bincount(which, cost, len(words[s:s + CHUNK])))
    return np.concatenate(out)


def map_curve(seen: np.ndarray) -> np.ndarray:
    """Probabilities on the points of the map; an unseen point keeps its own probability."""
    own = 1 / (1 + np.exp(-np.linspace(-8, 8, STEPS)))
    pair = seen.reshape(-1, STEPS, 2)
    return ((pair[:, :, 1] + 4 * own) / (pair.sum(axis=2) + 4)).ravel()


def with_recent(score: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 probabilities of a text's tokens after mixing in how often each was seen before in the text."""
    order = np.argsort(words, kind="stable")
    in_order = words[order]
    new = np.concatenate([[True], in_order[1:] != in_order[:-1]])
    run = np.maximum.accumulate(np.where(new, np.arange(len(words)), 0))
    seen = np.empty(len(words))
    seen[order] = np.arange(len(words)) - run
    natural = score * math.log(10)
    with np.errstate(divide="ignore"):
        recent = np.log(RECENT * seen[1:] / np.arange(1, len(words)))
    natural[1:] = np.logaddexp(natural[1:] + math.log(1 - RECENT), recent)
    return natural / math.log(10)


# --- token stream ------------------------------------------------------------------

def hashed_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, spelling, place of the first byte) of each lower-cased word; spelling is by the last two bytes, and ends with the sentence."""
    flat = LOWER[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate([[1], IS_SPACE[flat], [1]]).astype(np.int8))
    at, stop = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), at
    size = stop - at
    place = np.arange(len(flat)) - np.repeat(np.concatenate([[0], at]), np.diff(np.concatenate([[0], at, [len(flat)]])))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(size.max()), np.uint64(0x9E3779B97F4A7C15)))
        term = (flat + np.uint64(1)) * power[np.minimum(place, len(power) - 1)]
        term[IS_SPACE[flat]] = 0
        h = _scramble(np.add.reduceat(term, at) + size.astype(np.uint64))
    last, other = flat[stop - 1].astype(np.int64), flat[np.maximum(stop - 2, at)].astype(np.int64)
    return np.maximum(h, np.uint64(2)), np.where(IS_STOP[last], KINDS // 2, 0) + (last * 7 + other * 3) % (KINDS // 2), at


def _scramble(x: np.ndarray) -> np.ndarray:
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def key_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, spelling) of words and the end token."""
    h, kind, _ = hashed_words(b" ".join(keys))
    end = np.array([k == END for k in keys], dtype=bool)
    hashes, kinds = np.full(len(keys), END_HASH), np.zeros(len(keys), np.int64)
    hashes[~end], kinds[~end] = h, kind
    return hashes, kinds


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Part of the vocabulary in which a word stands."""
    return (hashes % np.uint64(parts)).astype(np.int64)


def streams(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, spelling, text number) of the tokens of runs of whole texts of about ``size`` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t)
        if held < size and i + 1 < len(texts):
            continue
        part = texts[first:i + 1]
        begins = np.cumsum([0, *[len(x) + 1 for x in part]])
        h, kind, at = hashed_words(b"\n".join([*part, b""]))
        words = np.bincount(np.searchsorted(begins, at, side="right") - 1, minlength=len(part))
        doc = np.repeat(np.arange(len(part)), words + 1)
        end = np.cumsum(words + 1) - 1
        inner = np.ones(len(doc), bool)
        inner[end] = False
        hashes, kinds = np.full(len(doc), END_HASH), np.zeros(len(doc), np.int64)
        hashes[inner], kinds[inner] = h, kind
        yield hashes, kinds, doc + first
        first, held = i + 1, 0


class Symbols:
    """Symbols of tokens and their prefix code.

    The end is symbol 0, the frequent words (hashes ``top``) follow, then one per spelling. ``counts``
    of all of them shape the tree. ``path`` names its nodes and bits.
    """

    def __init__(self, top: np.ndarray, counts: np.ndarray):
        top = np.concatenate([[END_HASH], top])
        order = np.argsort(top)
        self.sorted, self.number, self.own = top[order], order, len(top)
        heap = [(int(n) + 1, i, i) for i, n in enumerate(counts)]
        heapq.heapify(heap)
        up: dict[int, tuple[int, int]] = {}
        for node in range(len(counts), 2 * len(counts) - 1):
            (m, _, a), (n, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            up[a], up[b] = (node, 0), (node, 1)
            heapq.heappush(heap, (m + n, node, node))
        paths = []
        for i in range(len(counts)):
            path = []
            while i in up:
                path.append(up[i])
                i = up[i][0]
            paths.append(path)
        self.length = np.array([len(x) for x in paths], np.int64)
        self.start = np.cumsum(self.length) - self.length
        flat = np.array([x for path in paths for x in path], np.int64)
        self.bit = flat[:, 1]
        # Three levels of the tree stand together in one line of a table: a group of nodes, named by its upper one.
        group, local = {2 * len(counts) - 2: (2 * len(counts) - 2, 1)}, []
        for node in range(2 * len(counts) - 3, len(counts) - 1, -1):
            above, bit = up[node]
            top_, at = group[above]
            group[node] = (top_, 2 * at + bit) if at < 4 else (node, 1)
        self.group = np.array([group[x][0] for x in flat[:, 0].tolist()], np.uint32) * np.uint32(0x2545F491)
        self.local = np.array([group[x][1] for x in flat[:, 0].tolist()], np.int64)

    def of(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.own - 1)
        return np.where(self.sorted[at] == hashes, self.number[at], self.own + kinds)

    def path(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of decisions of each token; group, place in the group and bit of every decision."""
        n = self.length[symbols]
        at = np.repeat(self.start[symbols] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        return n, self.group.take(at), self.local.take(at), self.bit.take(at)


def word_contexts(symbols: np.ndarray, hashes: np.ndarray, kinds: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Contexts of each token [contexts, tokens]: what stands before it in its text."""
    def before(x: np.ndarray, k: int) -> np.ndarray:
        out = np.zeros(len(x), np.uint32)
        out[k:] = np.where(doc[k:] == doc[:-k], x[:-k], 0)
        return out

    word = (hashes >> np.uint64(32)).astype(np.uint32)
    mark = (symbols + 1).astype(np.uint32)
    begins = np.where(kinds >= KINDS // 2, 1, 2)
    w1, w2, w3, s1, s2 = before(word, 1), before(word, 2), before(word, 3), before(mark, 1), before(mark, 2)
    pair = w1 * np.uint32(0x2C1B3C6D) + w2 * np.uint32(0x297A2D39)
    out = np.stack([before(begins, 1), s1, w1, pair, s1 * np.uint32(0x1000) + s2, pair * np.uint32(0x45D9F3B) + w3])
    out = (out + np.arange(1, CONTEXTS + 1, dtype=np.uint32)[:, None] * np.uint32(0x61C88647)) * np.uint32(0x9E3779B1)
    return out ^ out >> np.uint32(15)


def _slots(context: np.ndarray, n: np.ndarray, group: np.ndarray, local: np.ndarray) -> np.ndarray:
    mixed = np.repeat(context, n)
    mixed += group
    mixed *= np.uint32(0x85EBCA77)
    mixed ^= mixed >> np.uint32(13)
    mixed *= np.uint32(0xC2B2AE3D)
    mixed >>= np.uint32(35 - SLOT_BITS)
    at = mixed.astype(np.int64)
    at <<= 3
    at += local
    return at


def _levels(pair: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts of the gate: how often two words and one word before were seen."""
    return (np.minimum(np.log2(pair + 1), GATES[0] - 1).astype(np.uint8) * np.uint8(GATES[1]),
            np.minimum(np.log2(one + 1) / 2, GATES[1] - 1).astype(np.uint8))


class Learner:
    """Predicts, learns and counts the tokens of one team of texts, in order."""

    def __init__(self, symbols: Symbols):
        self.symbols, self.counters = symbols, fresh_counters()
        self.weights, self.squares = np.full((GATES[0] * GATES[1], CONTEXTS), 0.3), np.zeros((GATES[0] * GATES[1], CONTEXTS))
        self.seen, self.total = np.zeros(GATES[0] * STEPS * 2), 0

    def take(self, texts: list[bytes], rate: float = 0.02) -> None:
        for hashes, kinds, doc in streams(texts):
            s = self.symbols.of(hashes, kinds)
            contexts = word_contexts(s, hashes, kinds, doc)
            for i in range(0, len(s), STREAM):
                self._step(s[i:i + STREAM], contexts[:, i:i + STREAM], rate)

    def _step(self, s: np.ndarray, contexts: np.ndarray, rate: float) -> None:
        n, group, local, y = self.symbols.path(s)
        places, logits, known = [], [], {}
        for k in range(CONTEXTS):
            at = _slots(contexts[k], n, group, local)
            pair = self.counters[k].view(np.uint64).take(at, mode="clip").view(np.float32)
            if k in (2, 3):
                known[k] = pair[::2] + pair[1::2]
            pair += np.float32(PRIOR)
            logits.append(np.log(pair[1::2] / pair[::2]))
            at <<= 1
            at += y
            places.append(at)
        high, low = _levels(known[3], known[2])
        gate = (high + low).astype(np.int64)
        total = mix(logits, gate, self.weights.astype(np.float32))
        error = y.astype(np.float32) - 1 / (1 + np.exp(-total))
        size = np.maximum(np.bincount(gate, minlength=len(self.weights)), 1)
        for k in range(CONTEXTS):
            g = np.bincount(gate, error * logits[k], len(self.weights)) / size
            self.squares[:, k] += g * g
            self.weights[:, k] += np.where(g == 0, 0, rate * g / np.sqrt(self.squares[:, k] + 1e-8))
            np.add.at(self.counters[k], places[k], np.float32(1))
        point, up = on_map(total)
        at = ((gate // GATES[1]) * STEPS + point) * 2 + y
        self.seen += np.bincount(at, 1 - up, len(self.seen)) + np.bincount(at + 2, up, len(self.seen))
        self.total += len(y)


class Stream:
    """The learned model of the token stream: logits and gate levels by slot."""

    def __init__(self, symbols: Symbols, packed: list[bytes], weights: np.ndarray, curve: np.ndarray):
        self.symbols, self.weights, self.curve, self.logit = symbols, weights / np.float32(2048), curve, []
        for k in range(CONTEXTS):
            n = _unpack(packed[k], np.float32).reshape(-1, 2) if packed else np.zeros((1 << SLOT_BITS, 2), np.float32)
            logit = np.log((n[:, 1] + np.float32(PRIOR)) / (n[:, 0] + np.float32(PRIOR)))
            self.logit.append(np.round(np.clip(logit, -15, 15) * 2048).astype(np.int16))
            if k == 2:
                one = n.sum(axis=1)
            if k == 3:
                self.high, self.low = _levels(n.sum(axis=1), one)

    def score(self, s: np.ndarray, contexts: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each symbol ``s``."""
        out = np.empty(len(s))
        for i in range(0, len(s), STREAM):
            n, group, local, y = self.symbols.path(s[i:i + STREAM])
            at = [_slots(contexts[k, i:i + STREAM], n, group, local) for k in range(CONTEXTS)]
            gate = (self.high.take(at[3], mode="clip") + self.low.take(at[2], mode="clip")).astype(np.int64)
            total = mix([x.take(a, mode="clip") for x, a in zip(self.logit, at)], gate, self.weights)
            point, up = on_map(total)
            level = gate // GATES[1] * STEPS + point
            refined = self.curve[level] * (1 - up) + self.curve[level + 1] * up
            p = np.clip((1 / (1 + np.exp(-total)) + refined) / 2, LOW, 1 - LOW)
            out[i:i + STREAM] = np.bincount(np.repeat(np.arange(len(n)), n), np.log(np.where(y == 1, p, 1 - p).astype(np.float64)), len(n))
        return out


def fit_stream(rows: DataFrame, total: int, symbols: Symbols) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(counters, weights, map) of the token stream of training texts (id, text, th).

    Every token of every text is visited. A team holds about ``TEAM_BYTES`` of texts and sends its counters
    once, packed and cut into segments, which are summed apart from each other.
    """
    teams = max(1, math.ceil(total / TEAM_BYTES))
    shared = rows.sparkSession.sparkContext.broadcast(symbols)
    dealt = rows.withColumn("team", F.pmod(F.xxhash64("id", "th", F.lit(3)), F.lit(teams)).cast("int"))
    dealt = dealt.repartition(teams, "team").sortWithinPartitions("team", "id", "th").select("team", "text")

    def learn_team(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        team, learner = None, None

        def told() -> pd.DataFrame:
            out = [(team, k, i, _pack(part), 0, b"", b"") for k in range(CONTEXTS) for i, part in enumerate(np.split(learner.counters[k], SEGMENTS))]
            out.append((team, -1, 0, b"", learner.total, learner.weights.tobytes(), learner.seen.tobytes()))
            return pd.DataFrame(out, columns=["team", "context", "segment", "data", "total", "weights", "seen"])

        for frame in frames:
            for number, part in frame.groupby("team", sort=True):
                if number != team:
                    if learner:
                        yield told()
                    team, learner = int(number), Learner(shared.value)
                learner.take([raw(t) for t in part["text"]])
        if learner:
            yield told()

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2 << SLOT_BITS) // SEGMENTS, np.float64)
        for x in frame["data"]:
            total += _unpack(x, np.float32)
        return pd.DataFrame({"context": [frame["context"].iloc[0]], "segment": [frame["segment"].iloc[0]], "data": [_pack(total.astype(np.float32))]})

    schema = "team int, context int, segment int, data binary, total long, weights binary, seen binary"
    learned = materialize(dealt.mapInPandas(learn_team, schema), "learned")
    let_go(rows.sparkSession)
    sums = learned.where("context >= 0").select("context", "segment", "data").groupBy("context", "segment")
    parts = {(r.context, r.segment): bytes(r.data) for r in sums.applyInPandas(add, "context int, segment int, data binary").collect()}  # of fixed size
    packed = [_pack(np.concatenate([_unpack(parts[k, i], np.float32) for i in range(SEGMENTS)])) for k in range(CONTEXTS)] if parts else []
    weights, seen, n = np.zeros((GATES[0] * GATES[1], CONTEXTS)), np.zeros(GATES[0] * STEPS * 2), 0
    for r in learned.where("context < 0").orderBy("team").select("total", "weights", "seen").collect():  # one short row per team
        weights += r.total * np.frombuffer(r.weights).reshape(weights.shape)
        seen += np.frombuffer(r.seen)
        n += r.total
    release(learned)
    shared.destroy()
    del sums
    let_go(rows.sparkSession)
    weights = weights / n if n else np.full(weights.shape, 0.3)
    return packed, weights.astype(np.float32), map_curve(seen).astype(np.float32)


# --- corpus ----------------------------------------------------------------------

def _merge(frame: pd.DataFrame) -> tuple[list[bytes], np.ndarray, list[np.ndarray]]:
    """(distinct keys of a part, their training counts, key numbers of every row)."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(k, len(number)) for k in keys.split(b" ")], dtype=np.int64) for keys in frame["keys"]]
    counts = np.zeros(len(number), np.int64)
    for at, n in zip(rows, frame["counts"]):
        np.add.at(counts, at, np.frombuffer(n, np.int64))
    return list(number), counts, rows


def _gather(frames: Iterator[pd.DataFrame], parts: int) -> Iterator[pd.DataFrame]:
    """Distinct keys of each block by part, in the order of their hashes, with their counts in its training texts."""
    rows = list(frames)
    if not rows:
        return
    for block, group in pd.concat(rows, ignore_index=True).groupby("block", sort=True):
        taught: Counter = Counter()
        for text, held in zip(group["text"], group["held"]):
            if held:
                taught.update(dict.fromkeys(tokens(text), 0))
            else:
                taught.update(tokens(text))
        keys = np.array(list(taught), dtype=object)
        names = key_hashes(keys)[0]
        part = part_of(names, parts)
        order = np.lexsort((names, part))
        keys, part, n = keys[order], part[order], np.fromiter(taught.values(), np.int64, len(taught))[order]
        cuts = np.nonzero(np.diff(part, prepend=-1, append=-1))[0]
        yield pd.DataFrame([
            (int(part[i]), int(block), b" ".join(keys[i:j]), n[i:j].tobytes()) for i, j in zip(cuts[:-1], cuts[1:])],
            columns=["part", "block", "keys", "counts"])


def _vocabulary(frame: pd.DataFrame) -> pd.DataFrame:
    """Known words of a part, sorted, with their counts, the most frequent ones, and sums by spelling."""
    keys, counts, _ = _merge(frame)
    known = sorted((k, int(n)) for k, n in zip(keys, counts) if n > 0)
    if not known:
        return pd.DataFrame([], columns=["keys", "counts", "n", "v", "top", "sums"])
    words, n = [k for k, _ in known], np.array([n for _, n in known], np.int64)
    kinds, word = key_hashes(words)[1], np.array([k != END for k in words])
    sums = np.stack([np.bincount(kinds[word], w, KINDS) for w in (n[word], None)]).astype(np.int64)
    top = [{"n": -m, "word": k} for m, k in sorted((-m, k) for k, m in known if k != END)[:TOP]]
    row = (b" ".join(words), n.tobytes(), int(n.sum()), len(words), top, sums.ravel().tolist())
    return pd.DataFrame([row], columns=["keys", "counts", "n", "v", "top", "sums"])


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The words of each part in a fixed shuffled order, some at a time; rows arrive sorted."""
    for frame in frames:
        for keys, n in zip(frame["keys"], frame["counts"]):
            words, counts = keys.split(b" "), np.frombuffer(n, np.int64)
            order = np.random.default_rng(6).permutation(len(words))
            for s in range(0, len(order), CHUNK):
                at = order[s:s + CHUNK]
                yield [words[i] for i in at], counts[at]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def fit(vocabulary: DataFrame, tasks: int) -> tuple:
    """(counters, weights, map) of the spelling model from a vocabulary of (keys, counts) rows.

    The counters have a fixed size. A task sends them once, packed, one row per context; per
    context they are summed in one task. So is what the tasks learn about mixing.
    """
    rows = vocabulary.select("keys", "counts").repartition(tasks, F.xxhash64("keys")).sortWithinPartitions("keys")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters, any_ = fresh_counters(), False
        for words, counts in _chunks(frames):
            any_ = True
            count_bits(counters, words, counts)
        if any_:
            yield pd.DataFrame({"context": range(CONTEXTS), "data": [_pack(c) for c in counters]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(2 << SLOT_BITS, np.float64)
        for x in frame["data"]:
            total += _unpack(x, np.float32)
        return pd.DataFrame({"context": [frame["context"].iloc[0]], "data": [_pack(total.astype(np.float32))]})

    sums = rows.mapInPandas(count, "context int, data binary").groupBy("context").applyInPandas(add, "context int, data binary")
    packed = {r.context: bytes(r.data) for r in sums.collect()}  # six rows of fixed size
    del sums
    let_go(vocabulary.sparkSession)
    spark = vocabulary.sparkSession
    sent = spark.sparkContext.broadcast(packed)
    gates = GATES[0] * GATES[1]

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counters = None
        weights, squares = np.full((gates, CONTEXTS), 0.3), np.zeros((gates, CONTEXTS))
        seen, total = np.zeros(GATES[0] * STEPS * 2), 0.0
        for words, counts in _chunks(frames):
            counters = unpacked(sent.value) if counters is None else counters
            total += learn(counters, weights, squares, seen, words, counts)
        if total:
            yield pd.DataFrame([(total, weights.tobytes(), seen.tobytes())], columns=["total", "weights", "seen"])

    weights, seen, total = np.zeros((gates, CONTEXTS)), np.zeros(GATES[0] * STEPS * 2), 0.0
    told = rows.mapInPandas(train, "total double, weights binary, seen binary").collect()  # one short row per task
    sent.destroy()
    for r in sorted(told, key=lambda r: (r.total, r.weights)):
        weights += r.total * np.frombuffer(r.weights).reshape(gates, CONTEXTS)
        seen += np.frombuffer(r.seen)
        total += r.total
    weights = weights / total if total else np.full((gates, CONTEXTS), 0.3)
    return packed, weights.astype(np.float32), map_curve(seen).astype(np.float32)


def _symbols(vocabulary: DataFrame, n: int) -> tuple[Symbols, np.ndarray, np.ndarray]:
    """(symbols, training tokens and distinct words of each) from the sums and the most frequent words of the parts."""
    most = vocabulary.select(F.explode("top").alias("t")).orderBy(F.desc("t.n"), "t.word").limit(TOP).select("t.n", "t.word").collect()  # TOP rows
    words, counts = [bytes(r.word) for r in most], np.array([r.n for r in most], np.int64)
    sums = np.zeros((2, KINDS), np.int64)
    for r in vocabulary.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect():  # of fixed size
        sums[r.pos // KINDS, r.pos % KINDS] = r.n
    hashes, kinds = key_hashes(words)
    ends = n - int(sums[0].sum())
    sums[0] -= np.bincount(kinds, counts, KINDS).astype(np.int64)
    sums[1] -= np.bincount(kinds, minlength=KINDS)
    share, distinct = (np.concatenate([[ends], own, x]) for own, x in ((counts, sums[0]), (np.ones(len(words), np.int64), sums[1])))
    return Symbols(hashes, share), share, distinct


def unpacked(packed: dict) -> np.ndarray:
    counters = fresh_counters()
    for k, data in packed.items():
        counters[k] = _unpack(data, np.float32)
    return counters


def score_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", held_out=None, block_bytes: int = BLOCK_BYTES,
                part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per input row: ``id``, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Tokens are the lower-case words and an end; texts outside ``held_out`` teach. base_score sums
    log10((c + 0.1) / (N + 0.1 (V + 1))); score is the log10 probability of all tokens under the
    model; bits_per_byte is its cost for each byte of the words and their separators. Null and
    empty texts have the end token only. A row with a null id teaches. Repeated rows count as
    often as they occur; an empty table gives an empty result; extra columns are ignored. With
    nothing to learn from, base_score is log10(1) and the bit model gives every bit one half.
    """
    spark = docs.sparkSession
    total = text_bytes(docs, text)
    blocks, parts = max(1, math.ceil(total / block_bytes)), max(1, math.ceil(total / part_bytes))
    held = remainder(F.col(id), 10) == 0 if held_out is None else held_out
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held, F.lit(False)).alias("held"))
    taught = rows.where(~F.col("held")).select("id", "text", F.xxhash64("text").alias("th"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")).repartition(blocks, "block")
    sent = rows.mapInPandas(lambda f: _gather(f, parts), "part int, block int, keys binary, counts binary")
    gathered = materialize(sent, "gathered")
    by_part = gathered.groupBy("part")
    schema = "keys binary, counts binary, n long, v long, top array<struct<n: long, word: binary>>, sums array<long>"
    vocabulary = materialize(by_part.applyInPandas(_vocabulary, schema), "vocabulary")
    let_go(spark)
    n, v = (int(x or 0) for x in vocabulary.agg(F.sum("n"), F.sum("v")).first())
    symbols, share, distinct = _symbols(vocabulary, n)
    stream = fit_stream(taught, total, symbols)
    model = fit(vocabulary, math.ceil(parts / 4))
    shared = spark.sparkContext.broadcast((*model, symbols, share, distinct))
    learned = spark.sparkContext.broadcast((symbols, *stream))

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        """Count of each word of a block in a part, in the order of hashes, and its log10 share of its symbol."""
        packed, weights, curve, symbols, share, distinct = shared.value
        counters = unpacked(packed)
        keys, c, at = _merge(frame)
        bit = word_bits(counters, weights, curve, keys)
        names, kinds = key_hashes(keys)
        s = symbols.of(names, kinds)
        of, kinds = share[s], distinct[s]
        first = np.log2(np.maximum(np.where(c > 0, c - DISCOUNT, 0) / np.maximum(of, 1), 1e-300))
        known = np.logaddexp2(first, bit + np.log2(np.maximum(DISCOUNT * kinds / np.maximum(of, 1), 1e-300)))
        score = np.where(s < symbols.own, 0, np.where(of > 0, known, bit)) * math.log10(2)
        once = [i[np.diff(names[i], prepend=np.uint64(0)) != 0] for i in at]
        return pd.DataFrame({
            "part": frame["part"], "block": frame["block"], "c": [c[i].tobytes() for i in once],
            "score": [score[i].astype(np.float32).tobytes() for i in once]})

    # A table of their own, made before the texts are shuffled again: neither words nor texts lie beside them on the disks.
    answers = materialize(by_part.applyInPandas(answer, "part int, block int, c binary, score binary"), "answers")
    release(gathered, vocabulary)
    shared.destroy()
    let_go(spark)

    def judge(key: tuple, texts: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        model = Stream(*learned.value)
        data, out, row, first = [raw(t) for t in texts["text"]], [], 0, 0
        ids, helds = texts["id"].tolist(), texts["held"].tolist()
        runs = list(streams(data))
        names, number = np.unique(np.concatenate([hashes for hashes, _, _ in runs]), return_inverse=True)
        told, order = told.sort_values("part"), np.argsort(part_of(names, parts), kind="stable")
        c, score = np.empty(len(names), np.int64), np.empty(len(names))
        c[order] = np.frombuffer(b"".join(told["c"]), np.int64)
        score[order] = np.frombuffer(b"".join(told["score"]), np.float32)
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        for hashes, kinds, doc in runs:
            s = model.symbols.of(hashes, kinds)
            each = model.score(s, word_contexts(s, hashes, kinds, doc)) / math.log(10)
            at = number[first:first + len(s)]
            first += len(s)
            each += score[at]
            edges = np.nonzero(np.diff(doc, prepend=-1, append=-1))[0]
            for i, j in zip(edges[:-1], edges[1:]):
                bytes_ = max(1, len(b" ".join([*data[row].split(), b" "])))
                total_ = float(with_recent(each[i:j], at[i:j]).sum())
                out.append((
                    ids[row], helds[row], int(j - i), int((c[at[i:j]] > 0).sum()), n, float(base[at[i:j]].sum()), total_, -total_ / math.log10(2) / bytes_))
                row += 1
        return pd.DataFrame(out, columns=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    scored = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(judge, schema)
    return scored.withColumnRenamed("id", id)
