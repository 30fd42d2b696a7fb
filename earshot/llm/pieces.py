"""Sampled SentencePiece segmentations without replacement, and decoding.

The lattice of a text has a node per character and an edge per vocabulary piece; a character without a piece is one
edge of byte pieces. As no piece goes on past a word into the next space, the lattice is a chain of unit lattices
(spaces and the word behind them), and equal units, as well as equal endings of units, share one. The vocabulary file
ranks pieces by merge order and holds no probabilities; a piece of rank r has weight ``-alpha * log(r + 1)``, and a
segmentation's probability is proportional to the exponential of its sum.

Gumbel top-k: perturbed A-star search. Exact backward sums give the probability of every edge given its node. The root
draws a Gumbel value; a path that follows the edges' probabilities inherits it as its maximum, and at each of its
steps the edges not taken form a group whose maximum is a Gumbel value of the group's mass, truncated at the path's
(which keeps their order, so that only a document's largest is truncated). Popping the best group of all gives the
next best perturbed segmentation, and splits the group. So the k results are distinct, each comes with its log
probability, and with its inclusion score at the (k+1)-th value. All documents of a batch take each step together in
numpy; random numbers are hashes of (seed, row key, sample, unit, step).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import rolling
from earshot.llm.store import arrow_map, text_chunks

#: Small, as the arrays of a batch are walked many times: at a quarter of a megabyte they stay near the processor.
CHUNK_BYTES = 1 << 18
#: Lattices are made for the distinct units of a longer stretch of texts, a part of the nodes at a time.
LATTICE_BYTES = 1 << 22
NODES_AT_ONCE = 1 << 16
SPACE = 0x2581
#: A literal U+2581 in a text, told from the mark of a space.
LITERAL = 0x110000
UNITS_AT_ONCE = 1 << 15


class Vocabulary:
    """Pieces of a model file with their weights, found by the hash of their code points."""

    def __init__(self, model_path: str, alpha: float):
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        self.longest = max(map(len, texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        prefix = point_prefix(points)
        hashes = rolling.substring_hashes(prefix, np.concatenate(([0], ends[:-1])), ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(plain)[order]
        rank = np.arange(len(plain), dtype=np.float64)
        self.weights = (-alpha * np.log(rank + 1))[order]
        self.byte_weight = -alpha * float(np.log(len(plain) + 1))
        # behind the pieces, characters spelled in one byte to four
        self.weight_of_row = np.append(self.weights, self.byte_weight * np.arange(1, 5))
        self.id_of_row = np.append(self.ids, [-1] * 4).astype(np.int32)
        self.bytes = {model.piece_to_id(f"<0x{b:02X}>"): bytes([b]) for b in range(256)}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
        self.raw = pa.array([self.bytes.get(i, model.id_to_piece(i).replace(chr(SPACE), " ").encode()) for i in range(n)], pa.binary())
        # by the top bits of the hash: a piece has it, or the beginning of a piece
        self._seen = np.zeros(1 << 22, dtype=np.uint8)
        size = np.diff(ends, prepend=0)
        for k in range(1, self.longest + 1):
            on = np.flatnonzero(size >= k)
            begin = (ends - size)[on]
            self._seen[(rolling.substring_hashes(prefix, begin, begin + k) >> np.uint64(42)).astype(np.int64)] |= 1
        slot = (self.hashes >> np.uint64(42)).astype(np.int64)
        self._seen[slot] |= 2
        # the place of the slot's last piece; slots of several pieces are searched
        self._place = np.zeros(len(self._seen), dtype=np.uint16 if len(slot) <= 1 << 16 else np.uint32)
        self._place[slot] = np.arange(len(slot))
        self._seen[slot[1:][slot[1:] == slot[:-1]]] |= 4

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which hashes are pieces, their places, and which may be the beginning of a piece."""
        slot = (hashes >> np.uint64(42)).view(np.int64)
        seen = self._seen[slot]
        near = np.flatnonzero(seen & 2)
        sought = hashes[near]
        at = self._place[slot[near]].astype(np.int64)
        many = np.flatnonzero(seen[near] & 4)
        at[many] = np.minimum(np.searchsorted(self.hashes, sought[many]), len(self.hashes) - 1)
        real = self.hashes[at] == sought
        return near[real], at[real], np.flatnonzero(seen & 1)

    def decode(self, ids: pa.ListArray) -> list[str]:
        """The texts of segmentations, less the space put before each."""
        pieces = self.raw.take(ids.values)
        if not len(pieces):
            return [""] * len(ids)
        _, offsets, data = pieces.buffers()
        # the pieces taken stand together, so a text is a stretch of them
        bounds = np.frombuffer(offsets, dtype=np.int32)[pieces.offset :][ids.offsets.to_numpy()].tolist()
        held = memoryview(data)
        return [str(held[b + 1 : e], "utf-8", "replace") for b, e in zip(bounds[:-1], bounds[1:], strict=True)]


_loaded: dict[tuple[str, float], Vocabulary] = {}


def vocabulary(model_path: str, alpha: float) -> Vocabulary:
    """The vocabulary of this worker process."""
    if (model_path, alpha) not in _loaded:
        _loaded[model_path, alpha] = Vocabulary(model_path, alpha)
    return _loaded[model_path, alpha]


#: The words of the code points that are two bytes long.
POINT_WORD = rolling.mix(np.arange(1 << 16, dtype=np.uint64) + rolling.BASE)


def point_words(points: np.ndarray) -> np.ndarray:
    """A random word per code point."""
    if points.max(initial=0) < len(POINT_WORD):
        return POINT_WORD[points]
    return rolling.mix(points.astype(np.uint64) + rolling.BASE)


def point_prefix(points: np.ndarray) -> np.ndarray:
    """Prefix sums for the hashes of runs of code points."""
    out = np.zeros(len(points) + 1, dtype=np.uint64)
    words = point_words(points)
    words *= rolling.powers(len(points))[0]
    np.cumsum(words, out=out[1:])
    return out


class Lattices:
    """Distinct units. A node is what is left of a unit, so units with one ending share its nodes.

    The edges of a node stand together, the likeliest first, and the node goes by the first of them: the node behind an
    edge (-1: the unit's end), its piece (below 0: a character spelled in bytes, as -1 less its code point), its share,
    and the share of the node's others.
    """

    def __init__(self, vocab: Vocabulary, points: np.ndarray, starts: np.ndarray, size: np.ndarray):
        points = points[np.repeat(starts, size) + rolling.ragged_arange(size)]
        ends = np.cumsum(size)
        to_go = np.repeat(ends, size) - np.arange(len(points))
        prefix = point_prefix(points)
        of, _ = pd.factorize(rolling.substring_hashes(prefix, np.arange(len(points)), np.repeat(ends, size)))
        nodes = int(of.max()) + 1
        at = np.empty(nodes, dtype=np.int64)
        at[of[::-1]] = np.arange(len(of))[::-1]
        # nodes with one number of characters to go are one level, small numbers sort in linear time
        left = to_go[at]
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        place = np.empty(nodes, dtype=np.int64)
        place[order] = np.arange(nodes)
        at, left, node_of = at[order], left[order], np.append(place[of], -1)
        word = point_words(points)
        # the last places hold what stands for a unit's end
        total, first = np.zeros(nodes + 1), np.full(nodes + 1, -1, dtype=np.int64)
        kinds, done = (np.int64, np.int32, np.float64, np.float64, np.float64), 0
        columns = [np.empty(3 * nodes, dtype=kind) for kind in kinds]
        for begin in range(0, nodes, NODES_AT_ONCE):
            cut = slice(begin, min(begin + NODES_AT_ONCE, nodes))
            part = self._part(vocab, points, word, node_of, at[cut], left[cut], begin, total, first, done)
            edges = done + len(part[0])
            if edges > len(columns[0]):
                columns = [np.concatenate((c[:done], np.empty(2 * edges - done, dtype=c.dtype))) for c in columns]
            for column, some in zip(columns, part, strict=True):
                column[done:edges] = some
            done = edges
        self.ahead, self.piece, self.share, self.upto, self.rest = (c[:done] for c in columns)
        self.base = first[node_of[ends - size]]
        self.first = first
        self.first[-1] = done
        self.width = int(np.diff(self.first).max())

    @staticmethod
    def _part(vocab, points, word, node_of, at, to_go, lo: int, total, first, done: int):
        """Edges of the nodes from ``lo`` on, which stand at ``at`` and are sorted by characters to go."""
        nodes = len(at)
        power = rolling.powers(vocab.longest)[0]
        live, here, hashes = np.arange(nodes), at, np.zeros(nodes, dtype=np.uint64)
        count, found = np.zeros(nodes, dtype=np.int64), []

        def behind(node, k):
            return np.where(to_go[node] == k, -1, node_of[at[node] + k])

        for k in range(1, min(vocab.longest, int(to_go[-1])) + 1):
            cut = np.searchsorted(live, np.searchsorted(to_go, k))
            live, here = live[cut:], here[cut:]
            hashes = hashes[cut:] + word[here + (k - 1)] * power[k - 1]
            hit, row, onward = vocab.find(rolling.mix(hashes + rolling.length_word(k)))
            hit = live[hit]
            count[hit] += 1
            found.append((hit, row, behind(hit, k)))
            live, here, hashes = live[onward], here[onward], hashes[onward]
        alone = np.ones(nodes, dtype=bool)
        alone[found[0][0]] = False
        alone = np.flatnonzero(alone)
        code = points[at[alone]].astype(np.int64)
        code[code == LITERAL] = SPACE
        spelled = (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        count[alone] += 1
        found.append((alone, len(vocab.ids) + spelled, behind(alone, 1)))
        # found by lengths, wanted by nodes: every length has at most one edge of a node
        head = np.cumsum(count) - count
        edges = int(count.sum())
        row, ahead = np.empty(edges, np.int64), np.empty(edges, np.int64)
        spot = head.copy()
        for hit, of_piece, node in found:
            place = spot[hit]
            spot[hit] += 1
            row[place], ahead[place] = of_piece, node
            coded = place
        weight, piece = vocab.weight_of_row[row], vocab.id_of_row[row]
        piece[coded] = -1 - code
        first[lo : lo + nodes] = head + done
        # backward sums, level by level
        share = np.empty(edges)
        levels = np.concatenate(([0], np.flatnonzero(to_go[1:] != to_go[:-1]) + 1, [nodes]))
        bounds = np.append(head, edges)[levels].tolist()
        levels = levels.tolist()
        for low, high, begin, end in zip(levels[:-1], levels[1:], bounds[:-1], bounds[1:], strict=True):
            value = weight[begin:end] + total[ahead[begin:end]]
            group, of_group = head[low:high] - begin, count[low:high]
            top = np.maximum.reduceat(value, group)
            value -= np.repeat(top, of_group)
            np.exp(value, out=value)
            whole = np.add.reduceat(value, group)
            total[lo + low : lo + high] = top + np.log(whole)
            np.divide(value, np.repeat(whole, of_group), out=share[begin:end])
        # the likeliest edge of a node first; for it the sum of the others, as one less its share loses digits
        best, most, others, node = head.copy(), share[head], np.zeros(nodes), np.flatnonzero(count > 1)
        j = 1
        while len(node):
            place = head[node] + j
            value, top = share[place], most[node]
            others[node] += np.minimum(value, top)
            more = np.flatnonzero(value > top)
            most[node[more]], best[node[more]] = value[more], place[more]
            j += 1
            node = node[np.flatnonzero(count[node] > j)]
        moved = np.flatnonzero(best != head)
        ahead = first[ahead]
        for x in (ahead, piece, share):
            x[head[moved]], x[best[moved]] = x[best[moved]], x[head[moved]]
        upto = np.cumsum(share)
        upto -= np.repeat(upto[head] - most, count)
        upto[head + count - 1] = 2.0
        rest = 1 - share
        rest[head] = others
        return ahead, piece, share, upto, rest

    def node(self, edge: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, edge, side="right") - 1

    def pick(self, head: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, given by its first, with probability in proportion to its share."""
        edge = head.copy()
        beyond = np.flatnonzero(u >= self.upto[edge])
        while len(beyond):
            further = edge[beyond] + 1
            edge[beyond] = further
            beyond = beyond[np.flatnonzero(u[beyond] >= self.upto[further])]
        return edge

    def table(self, node: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """Shares of the edges of a few nodes, one row each, without those in the bit set ``taken``."""
        j = np.arange(self.width)
        at = self.first[node][:, None] + j
        free = (at < self.first[node + 1][:, None]) & ((taken[:, None] >> j & 1) == 0)
        return np.where(free, self.share[np.minimum(at, len(self.share) - 1)], 0.0)


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit keys."""
    return ((rolling.mix(key.copy()) >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def gumbel(key: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(uniform(key)))


def truncated(location: np.ndarray, key: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel values at ``location`` given that they are at most ``bound``."""
    return truncate(location + gumbel(key), bound)


def truncate(value: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Turns Gumbel values into such that are at most ``bound``; of values with one bound the largest stays the largest."""
    with np.errstate(invalid="ignore"):
        out = np.minimum(bound, value) - np.log1p(np.exp(-np.abs(bound - value)))
    return np.where(np.isneginf(value), -np.inf, out)


def choose(share: np.ndarray, u: np.ndarray) -> np.ndarray:
    """An edge per row with probability in proportion to its share."""
    cum = np.cumsum(share, axis=1)
    pick = (cum < (u * cum[:, -1])[:, None]).sum(axis=1)
    # rounding may end on an edge without share
    bad = share[np.arange(len(share)), pick.clip(max=share.shape[1] - 1)] <= 0
    pick[bad] = share[bad].argmax(axis=1)
    return pick


def walk(lattices: Lattices, node: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random paths from each ``node`` (its first edge; -1: none) to its unit's end: how many steps each has, and their edges in order."""
    count, edges = np.zeros(len(node), dtype=np.int64), [np.zeros(0, dtype=np.int64)]
    for begin in range(0, len(node), UNITS_AT_ONCE):
        at, k, steps = node[begin : begin + UNITS_AT_ONCE], key[begin : begin + UNITS_AT_ONCE], count[begin : begin + UNITS_AT_ONCE]
        who, parts = np.flatnonzero(at >= 0), []
        at, k = at[who], k[who]
        while len(who):
            edge = lattices.pick(at, uniform(k + np.uint64(len(parts))))
            parts.append((who, edge))
            steps[who] = len(parts)
            at = lattices.ahead[edge]
            live = np.flatnonzero(at >= 0)
            who, at, k = who[live], at[live], k[live]
        spot = np.cumsum(steps) - steps
        walked = np.empty(int(steps.sum()), dtype=np.int64)
        for i, (who, edge) in enumerate(parts):
            walked[spot[who] + i] = edge
        edges.append(walked)
    return count, np.concatenate(edges)


class Paths:
    """One sampled path per document: its steps, with the group of edges not taken at each."""

    def __init__(self, size, own, unit, edge, log, value, lattices: Lattices, seed, turn: int):
        self.unit, self.edge, self.value = unit, edge, value
        self.bounds = np.concatenate(([0], np.cumsum(size)))
        self.size = size
        self.log_share = log
        self.upto = np.concatenate(([0.0], np.cumsum(log)))
        self.log = self.upto[self.bounds[1:]] - self.upto[self.bounds[:-1]]
        self.taken = np.zeros(len(edge), dtype=np.int64)
        # whole groups: values before they are truncated, as only a document's largest is wanted
        self.group = np.full(len(edge), -np.inf)
        # groups that were split: per document the step and the value
        self.again: list[tuple[np.ndarray, np.ndarray]] = []
        self._seed, self._turn, self._lattices = seed, turn, lattices
        # groups before the step where this path left its parent belong to the parent: the last ``own`` steps have some
        at = np.repeat(self.bounds[1:] - own, own) + rolling.ragged_arange(own)
        doc = np.repeat(np.arange(len(size)), own)
        rest = lattices.rest[edge[at]]
        some = np.flatnonzero(rest > 0)
        at, doc = at[some], doc[some]
        # the group's mass and its Gumbel value by one logarithm
        self.group[at] = self.before(at, doc) + np.log(rest[some] / -np.log(uniform(self.keys(at, doc))))

    def before(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The log probability of the path up to steps ``at``."""
        return self.upto[at] - self.upto[self.bounds[doc]]

    def keys(self, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Random keys of steps, by seed, sample and place in the document."""
        place = (at - self.bounds[doc]).astype(np.uint64)
        return self._seed[doc] + np.uint64(self._turn << 40) + place * rolling.BASE_INVERSE

    def split(self, at: np.ndarray, doc: np.ndarray, bound: np.ndarray, turn: int) -> np.ndarray:
        """Takes an edge out of the groups at steps ``at`` and draws the maxima of what is left."""
        node = self._lattices.node(self.edge[at])
        first, key = self._lattices.first[node], self.keys(at, doc)
        self.taken[at] |= np.int64(1) << (self.edge[at] - first)
        place = choose(self._lattices.table(node, self.taken[at]), uniform(key + np.uint64(turn << 50)))
        self.taken[at] |= np.int64(1) << place
        with np.errstate(divide="ignore"):
            mass = np.log(self._lattices.table(node, self.taken[at]).sum(axis=1))
        self.group[at] = -np.inf
        for steps, values in self.again:
            values[doc[steps[doc] == at]] = -np.inf
        steps, values = np.full(len(self.size), -1), np.full(len(self.size), -np.inf)
        steps[doc], values[doc] = at, truncated(self.before(at, doc) + mass, key + np.uint64(turn << 51), bound)
        self.again.append((steps, values))
        return first + place

    def best(self) -> np.ndarray:
        """The value of every document's best group."""
        self.top = np.full(len(self.size), -np.inf)
        some = np.flatnonzero(self.size)
        if len(some):
            self.top[some] = np.maximum.reduceat(self.group, self.bounds[some])
        value = truncate(self.top, self.value)
        for _, values in self.again:
            value = np.maximum(value, values)
        return value

    def step_of(self, doc: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The steps of the best groups of some documents, which have the ``value``."""
        size = self.size[doc]
        at = np.repeat(self.bounds[doc], size) + rolling.ragged_arange(size)
        hit = at[np.flatnonzero(self.group[at] == np.repeat(self.top[doc], size))]
        step = hit[np.searchsorted(hit, self.bounds[doc])]
        for steps, values in self.again:
            same = np.flatnonzero(values[doc] == value)
            step[same] = steps[doc[same]]
        return step


class Units:
    """The units of a batch of texts, their documents and the hashes by which equal ones are known."""

    def __init__(self, texts: list[str]):
        size = np.array([len(t) + 1 if t else 0 for t in texts], dtype=np.int64)
        self.points = np.frombuffer("".join([" " + t for t in texts if t]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
        literal = np.flatnonzero(self.points == SPACE)
        space = self.points == 32
        self.points[space] = SPACE
        self.points[literal] = LITERAL
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        heads = np.cumsum(size) - size
        begins[heads[size > 0]] = True
        self.starts = np.flatnonzero(begins)
        ends = np.append(self.starts[1:], len(self.points))[: len(self.starts)]
        self.size = ends - self.starts
        self.names = rolling.substring_hashes(point_prefix(self.points), self.starts, ends)
        self.bounds = np.searchsorted(self.starts, np.append(heads, len(self.points)))


def sampled(vocab: Vocabulary, texts: list[str], seeds: np.ndarray, k: int) -> Iterator[list[tuple]]:
    """``sample`` by batches: the lattices of all units are made at once, as most units come again, and then walked."""
    cuts = list(text_chunks(pa.array(texts, pa.large_string()), CHUNK_BYTES))
    batches = [Units(texts[begin:end]) for begin, end in cuts]
    if not batches:
        return
    of, distinct = pd.factorize(np.concatenate([b.names for b in batches]))
    lattices = base = None
    if len(distinct):
        first = np.zeros(len(distinct), dtype=np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        moved = np.cumsum([0] + [len(b.points) for b in batches])
        starts = np.concatenate([b.starts + m for b, m in zip(batches, moved, strict=False)])[first]
        size = np.concatenate([b.size for b in batches])[first]
        lattices = Lattices(vocab, np.concatenate([b.points for b in batches]), starts, size)
        base = lattices.base[of]
    done = 0
    for (begin, end), units in zip(cuts, batches, strict=True):
        n = len(units.starts)
        yield [(begin + i, *row) for i, *row in _paths(vocab, lattices, texts[begin:end], seeds[begin:end], k, units.bounds, base[done : done + n] if n else None)]
        done += n


def sample(vocab: Vocabulary, texts: list[str], seeds: np.ndarray, k: int) -> list[tuple]:
    """For every text up to ``k`` segmentations: (text, rank, log probability, perturbed value, inclusion, ids)."""
    return [row for rows in sampled(vocab, texts, seeds, k) for row in rows]


def _paths(vocab: Vocabulary, lattices: Lattices | None, texts: list[str], seeds: np.ndarray, k: int, bounds: np.ndarray, base: np.ndarray | None):
    """Samples of a batch: ``bounds`` of the texts' units, whose lattices begin at the nodes ``base``."""
    n = len(texts)
    if base is None:
        return [(i, 1, 0.0, 0.0, 1.0, np.zeros(0, np.int32)) for i in range(n)]
    per_doc = np.diff(bounds)
    unit_key = np.repeat(seeds, per_doc) + rolling.ragged_arange(per_doc).astype(np.uint64)

    def sums(count: np.ndarray, per: np.ndarray) -> np.ndarray:
        upto = np.concatenate(([0], np.cumsum(count)))
        ends = np.cumsum(per)
        return upto[ends] - upto[ends - per]

    count, edge = walk(lattices, base, rolling.mix(unit_key + np.uint64(1 << 32)))
    root, size = gumbel(seeds ^ rolling.BASE), sums(count, per_doc)
    paths = [Paths(size, size, np.repeat(np.arange(len(base)), count), edge, np.log(lattices.share[edge]), root, lattices, seeds, 1)]
    alive = [np.ones(n, bool)]
    for turn in range(2, k + 2):
        values = np.stack([p.best() for p in paths])
        which, value = values.argmax(axis=0), values.max(axis=0)
        if turn == k + 1:
            last = value
            break
        live = ~np.isneginf(value)
        # the steps before stay, the unit goes on behind the new edge, later units are walked anew
        split, kept, new, unit = (np.zeros(n, dtype=np.int64) for _ in range(4))
        for r, p in enumerate(paths):
            mine = np.flatnonzero(live & (which == r))
            step = p.step_of(mine, value[mine])
            new[mine] = p.split(step, mine, value[mine], turn)
            split[mine], kept[mine], unit[mine] = step, step - p.bounds[mine], p.unit[step]
        docs = np.flatnonzero(live)
        later = bounds[docs + 1] - unit[docs]
        units = np.repeat(unit[docs], later) + rolling.ragged_arange(later)
        nodes = base[units]
        nodes[np.cumsum(later) - later] = lattices.ahead[new[docs]]
        count, walked = walk(lattices, nodes, rolling.mix(unit_key[units] + np.uint64(turn << 32)))
        own = np.zeros(n, dtype=np.int64)
        own[docs] = sums(count, later)
        size = kept + live + own
        begin = np.cumsum(size) - size
        path, of_unit, log = np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()), np.int64), np.empty(int(size.sum()))
        for r, p in enumerate(paths):
            mine = np.flatnonzero(live & (which == r))
            some = rolling.ragged_arange(kept[mine])
            to, source = np.repeat(begin[mine], kept[mine]) + some, np.repeat(p.bounds[mine], kept[mine]) + some
            path[to], of_unit[to], log[to] = p.edge[source], p.unit[source], p.log_share[source]
        at = begin[docs] + kept[docs]
        path[at], of_unit[at], log[at] = new[docs], unit[docs], np.log(lattices.share[new[docs]])
        at = np.repeat(begin + kept + live, own) + rolling.ragged_arange(own)
        path[at], of_unit[at], log[at] = walked, np.repeat(units, count), np.log(lattices.share[walked])
        paths.append(Paths(size, own, of_unit, path, log, value, lattices, seeds, turn))
        alive.append(live)
    out = []
    for r, p in enumerate(paths):
        wide, ends = lattices.piece[p.edge], p.bounds
        coded = np.flatnonzero(wide < 0)
        if len(coded):
            code = -1 - wide[coded]
            sizes = np.ones(len(wide), dtype=np.int64)
            sizes[coded] += (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
            raw = code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            wide = np.repeat(wide, sizes)
            wide[wide < 0] = vocab.byte_ids[np.frombuffer(raw, np.uint8)]
            ends = np.concatenate(([0], np.cumsum(sizes)))[ends]
        with np.errstate(over="ignore"):
            inclusion = -np.expm1(-np.exp(p.log - last))
        for i in np.flatnonzero(alive[r]).tolist():
            out.append((i, r + 1, float(p.log[i]), float(p.value[i]), float(inclusion[i]) if texts[i] else 1.0, wide[ends[i] : ends[i + 1]]))
    return out


def segmentations(
    docs: DataFrame, model_path: str, k: int = 3, alpha: float = 0.5, seed: int = 0, with_text: bool = False
) -> DataFrame:
    """``doc_id, rank, log_prob, perturbed, inclusion, ids`` of up to ``k`` distinct segmentations of every row.

    ``with_text`` adds ``text``, decoded from the ids in the same task.

    ``ids`` decode to the text, whatever it holds. Ranks follow the perturbed values. A text with fewer segmentations
    has them all, with inclusion 1; null and empty texts have one of no ids. Repeated rows of one doc_id and text get
    the same segmentations; rows without doc_id are seeded alike.
    """

    def run(batch):
        vocab = vocabulary(model_path, alpha)
        for begin, end in text_chunks(batch.column(1), LATTICE_BYTES):
            texts = [t or "" for t in batch.column(1).slice(begin, end - begin).to_pylist()]
            ids = batch.column(0).slice(begin, end - begin)
            seeds = rolling.mix(ids.fill_null(0).to_numpy().astype(np.uint64) + np.uint64(seed) * rolling.BASE_INVERSE)
            parts = (rows[b : b + 64] for rows in sampled(vocab, texts, seeds, k) for b in range(0, len(rows), 64))
            for part in parts:
                who, rank, log, value, inclusion, found = zip(*part, strict=True)
                sizes = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(sizes, pa.array(np.concatenate(found)))
                columns = [ids.take(pa.array(who)), pa.array(rank, pa.int32()), pa.array(log), pa.array(value), pa.array(inclusion), lists]
                if with_text:
                    columns.append(pa.array(vocab.decode(lists), pa.string()))
                yield pa.record_batch(columns, names=["doc_id", "rank", "log_prob", "perturbed", "inclusion", "ids", "text"][: len(columns)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, rank int, log_prob double, perturbed double, inclusion double, ids array<int>" + ", text string" * with_text
    return arrow_map(rows, run, schema)


def decoded(rows: DataFrame, model_path: str, alpha: float = 0.5) -> DataFrame:
    """``rows`` with ``text``, the text of ``ids``."""
    at = rows.columns.index("ids")

    def run(batch):
        vocab = vocabulary(model_path, alpha)
        yield pa.record_batch([*batch.columns, pa.array(vocab.decode(batch.column(at)), pa.string())], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    kinds = [f.dataType.simpleString() for f in rows.schema.fields] + ["string"]
    return arrow_map(rows, run, ", ".join(f"c{i} {k}" for i, k in enumerate(kinds))).toDF(*rows.columns, "text")
