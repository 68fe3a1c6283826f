"""Language-model scores: a word unigram base and a causal self-attention model.

Base.  Counts of all words of the training documents, and of an end token for each, are
summed over the corpus.  A document's base score needs the counts of its words: those of
the HOT most frequent words travel to the tasks (a bounded table), all other words meet
their counts in a join on the word's hash.

Model.  Texts become subword ids of a public tokenizer, once, with an end id each.  From
all training ids come unigram counts, counts of pairs of neighbours, and counts of ids
after the ids that their word has so far; each falls back on the one before (Witten-Bell),
so each distribution sums to one.  The most frequent PAIRS and SPELLINGS of these counts travel to
the tasks; every other count that a text asks for meets it in a join and lies beside the
text's ids, so that all counts are used, however many there are.  A causal self-attention layer looks at the places
before the current one, whose values are the ids that followed there: its weights are a
distribution over ids to copy, with a weight of its own for not copying.  Pairs, spellings (each
falling back on the counts below) and copies are mixed in shares learned for each class of
sureness of the spelling, so that a prediction sums to one over the vocabulary and costs no
softmax over it.  Embeddings, attention and shares are trained in numpy by gradient on windows
of WIDTH ids laid end to end over every training document: each id and each end is predicted
once, and every batch moves all parameters.  Each task
trains a copy, and copies are averaged by the ids they have seen.  In scoring, windows of
WIDTH ids overlap by WIDTH - STEP, and each id is scored once, in the window that gives
it most context.

Defined results: null text counts as empty: one end token.  Repeated rows score alike.
A null doc_id is never held out.  With no training documents base counts are zero, base_score
is null, and the model is the untrained one over equal unigrams.  An empty table gives no
rows; other columns are not looked at; texts of any length are scored whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.packing import END_ID, TOKENIZER, tokenizer_path
from tablewright.llm.session import discard, prepared, table, written
from tablewright.llm.subwords import WORD_END, subwords
from tablewright.llm.words import BASE, INVERSE, U64, chunks, mix, power, segment, string_lists

#: Words, pairs of ids, and ids in their words that travel to the tasks: the most frequent ones, at most so many; the others are joined.
HOT, PAIRS, SPELLINGS = 400_000, 500_000, 500_000
WIDTH, STEP, DIM = 32, 24, 8
#: Rows of embeddings: most ids share the last SHARED ones, the most frequent have their own.
ROWS, SHARED = 4096, 1024
BATCH, RATE = 192, 0.1
#: The most frequent ids, whose pairs are looked up by place.
TOP = 2048
#: Added to each unigram count.
FLOOR = 0.02
END_HASH = -1
#: Distinct words, or pairs, a task sums before it passes them on.
HELD = 1_000_000


class Lookup:
    """Slots for distinct 64-bit hashes: each lies in the first free one from where its leading bits point."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (2 * len(keys)).bit_length())
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.keys, self.slot = np.zeros(1 << bits, U64), np.zeros(len(keys), np.int64)
        left, at = np.arange(len(keys)), (keys >> self.shift).astype(np.int64)
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self.keys[at[won]], self.slot[left[won]] = keys[left[won]] | U64(1), at[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.last

    def spread(self, values: np.ndarray) -> np.ndarray:
        """The keys' values by slot."""
        out = np.zeros(self.last + 1, values.dtype)
        out[self.slot] = values
        return out

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, or -1. Hashes that differ in the lowest bit alone count as equal."""
        h = h | U64(1)
        at = (h >> self.shift).astype(np.int64)
        here = np.take(self.keys, at)
        miss = np.flatnonzero(here != h)
        if len(miss):
            at[miss[here[miss] == 0]] = -1
            live = miss[here[miss] != 0]
            while len(live):
                at[live] = (at[live] + 1) & self.last
                here = self.keys[at[live]]
                at[live[here == 0]] = -1
                live = live[(here != h[live]) & (here != 0)]
        return at


def level(n: str) -> Column:
    """Classes of nearly equal n."""
    return F.floor(16 * F.log2(F.col(n).cast("double"))).cast("int")


def lowest(counts: DataFrame, n: str, limit: int) -> int:
    """The lowest level whose rows and those of all higher ones are at most limit in number: whole levels, so that no order over all rows is needed."""
    taken, low = 0, 2**30
    for r in sorted(counts.groupBy(level(n).alias("level")).count().collect(), key=lambda r: -r["level"]):  # at most 16 * 63 rows
        taken += r["count"]
        if taken > limit:
            break
        low = r["level"]
    return low


def most(counts: DataFrame, n: str, limit: int) -> DataFrame:
    """The rows with the largest n, at most limit of them, in whole levels."""
    return counts.where(level(n) >= lowest(counts, n, limit))


# ---------------------------------------------------------------- word counts


def _word_counts(batches):
    """Partial counts (hash, n) of the training documents' words."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = docs = 0

    def merged():
        keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(inverse, np.concatenate([n for _, n in held]), minlength=len(keys)).astype(np.int64)

    def out(k, n):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], names=["h", "n"])

    with np.errstate(over="ignore"):
        for batch in batches:
            for _, _, raw, offsets in chunks(batch.column("text")):
                docs += len(offsets) - 1
                k, n = np.unique(segment(raw, offsets).prefix_hash(), return_counts=True)
                held.append((k, n))
                size += len(k)
                if size > 4 * HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > HELD:
                        yield out(*held.pop())
                        size = 0
        if held:
            yield out(*merged())
        if docs:
            yield out(np.array([END_HASH], np.int64).view(U64), np.array([docs]))


def word_counts(training: DataFrame) -> DataFrame:
    return training.select("text").mapInArrow(_word_counts, "h long, n long").groupBy("h").agg(F.sum("n").alias("c"))


def text_hashes(words) -> np.ndarray:
    """A hash of each text's words in their order, by which results of a text come together."""
    h = words.prefix_hash()
    mixed = np.concatenate(([U64(0)], np.cumsum(mix(h + mix(np.arange(len(h), dtype=U64) - words.first[words.doc].astype(U64))))))
    return (mixed[words.first[1:]] - mixed[words.first[:-1]]).view(np.int64)


class Words:
    """Scores of the words that travel to the tasks."""

    def __init__(self, h: np.ndarray, c: np.ndarray, total: int, distinct: int):
        order, floor = np.argsort(h), total + 0.1 * (distinct + 1)
        self.h, self.value = h[order], np.log10((c[order] + 0.1) / floor) if floor > 0 else np.zeros(len(c))

    def open(self) -> tuple[Lookup, np.ndarray]:
        """Lays the table out, once in a worker."""
        if not hasattr(self, "lookup"):
            self.lookup = Lookup(self.h)
            self.value = self.lookup.spread(self.value)
            del self.h, self.lookup.slot
        return self.lookup, self.value


def _base_parts(shared: Broadcast):
    """For each text: what the bounded table knows, and the words left for the join."""

    def run(batches):
        hot, value = shared.value.open()
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, raw, offsets in chunks(batch.column("text")):
                    n = b - a
                    words = segment(raw, offsets)
                    h = words.prefix_hash()
                    at = hot.find(h)
                    known = at >= 0
                    score = np.bincount(words.doc[known], value[at[known]], minlength=n).astype(np.float64)
                    found = np.bincount(words.doc[known], minlength=n)
                    order = np.lexsort((h[~known], words.doc[~known]))
                    rest, doc = h[~known][order], words.doc[~known][order]
                    fresh = np.ones(len(rest), bool)
                    fresh[1:] = (rest[1:] != rest[:-1]) | (doc[1:] != doc[:-1])
                    start = np.flatnonzero(fresh)
                    times = np.diff(np.concatenate((start, [len(rest)])))
                    per = np.bincount(doc[start], minlength=n)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").slice(a, n),
                            pa.array(text_hashes(words)),
                            pa.array(np.diff(words.first) + 1),
                            pa.array(found),
                            pa.array(score),
                            string_lists(rest[start].view(np.int64), per, pa.int64()),
                            string_lists(times.astype(np.int64), per, pa.int64()),
                        ],
                        names=["doc_id", "text_hash", "n_tokens", "hot_known", "hot_score", "rest", "times"],
                    )

    return run


# ---------------------------------------------------------------- subword ids


def _ids(path: str):
    """Each text's ids with the end id, as bytes."""

    def run(batches):
        store = subwords(path)
        with np.errstate(over="ignore"):
            for batch in batches:
                for a, b, raw, offsets in chunks(batch.column("text")):
                    words = segment(raw, offsets)
                    ids, size = store.ids(words) if len(words.starts) else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
                    length = np.diff(np.concatenate(([0], np.cumsum(size)))[words.first]) + 1
                    stream = np.full(int(length.sum()), END_ID, np.uint16)
                    body = np.ones(len(stream), bool)
                    ends = np.cumsum(length)
                    body[ends - 1] = False
                    stream[body] = ids
                    data, ends = stream.tobytes(), (2 * ends).tolist()
                    rows = [data[i:j] for i, j in zip([0, *ends], ends)]
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(text_hashes(words)), part.column("held"), pa.array(rows, pa.binary())], names=["doc_id", "text_hash", "held", "ids"])

    return run


def subword_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text_hash, held and ids of docs (doc_id, text, held)."""
    return docs.select("doc_id", "text", "held").mapInArrow(_ids(path), "doc_id long, text_hash long, held boolean, ids binary")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> int:
    return max(subwords(path).tokenizer.get_vocab().values()) + 1


def streams(batch: pa.RecordBatch, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The places of a batch's texts in a row: last ids (start for a text's first place), ids to predict, first places, lengths."""
    column = batch.column("ids").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    target = np.frombuffer(data, np.uint16, int(offsets[-1] - offsets[0]), int(offsets[0]) * 2).astype(np.int64)
    head, length = offsets[:-1] - offsets[0], np.diff(offsets)
    last = np.empty_like(target)
    last[1:] = target[:-1]
    last[head] = start
    return last, target, head, length


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """Of each id, and of the start behind them, whether it ends a word."""
    vocab = subwords(path).tokenizer.get_vocab()
    ends = np.zeros(vocabulary(path) + 1, bool)
    ends[[i for name, i in vocab.items() if name.endswith(WORD_END) or name.startswith("<|")]] = True
    ends[[END_ID, -1]] = True
    return ends


def spelled(last: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places within a word, and a hash of the word's ids before each of these."""
    n = len(last)
    ended = ends[last]
    begin = np.maximum.accumulate(np.where(ended, np.arange(n), 0))
    inside = np.flatnonzero(~ended)
    sums = np.cumsum(mix(last.astype(U64) + U64(1)) * power(BASE, n))
    run = (sums[inside] - sums[begin[inside]]) * power(INVERSE, n)[begin[inside]]
    return inside, mix(run + (inside - begin[inside]).astype(U64))


def _merged(held):
    """One row for each key of (keys ..., n), in order."""
    columns = [np.concatenate(x) for x in zip(*held)]
    order = np.lexsort(columns[-2::-1]) if len(columns) > 2 else np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for c in columns[:-1]:
        fresh[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(fresh)
    return tuple(c[first] for c in columns[:-1]) + (np.add.reduceat(columns[-1], first) if len(first) else columns[-1],)


def _id_counts(start: int, ends: np.ndarray, within: bool):
    """Partial counts of ids after the last id, or after the ids of their word: (context, id, n)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out(context, id_, n):
            return pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(id_.astype(np.int32)), pa.array(n)], names=["context", "id", "n"])

        for batch in batches:
            if not len(batch):
                continue
            last, target, _, _ = streams(batch, start)
            with np.errstate(over="ignore"):
                if within:
                    inside, context = spelled(last, ends)
                    # the order of a hash of both brings equal ones together
                    id_ = target[inside]
                    key = context ^ mix(id_.astype(U64))
                    order = np.argsort(key)
                    key, context, id_ = key[order], context[order], id_[order]
                else:
                    key = np.sort((last << 16 | target).astype(np.uint32))
                    context, id_ = (key >> 16).astype(U64), key & 0xFFFF
            first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
            held.append((context[first], id_[first].astype(np.int64), np.diff(np.concatenate((first, [len(key)])))))
            size += len(first)
            if size > 4 * HELD:
                held = [_merged(held)]
                size = len(held[0][0])
                if size > HELD:
                    yield out(*held.pop())
                    size = 0
        if held:
            yield out(*_merged(held))

    return run


# ---------------------------------------------------------------- the model


def rates(total: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What one sighting after a context is worth, what is fallen back on, and how sure the context is."""
    whole = np.maximum(total + kinds, 1)
    # how sure: the total by powers of two, and how many kinds it has among these
    level = 4 * np.minimum(np.log2(np.maximum(total, 1)), 14).astype(int) + np.minimum(4 * kinds / np.maximum(total, 1), 3).astype(int)
    return (1 / whole).astype(np.float32), (kinds / whole).astype(np.float32), (level + 2).astype(np.uint8)


class Facts:
    """Counts that a batch's texts brought along, of contexts and ids that do not travel to the tasks."""

    def __init__(self, context: np.ndarray, id_: np.ndarray, n: np.ndarray, total: np.ndarray, kinds: np.ndarray):
        keys, first = np.unique(Followers.key(context, id_), return_index=True)
        self.lookup, rate = Lookup(keys), rates(total[first], kinds[first])
        self.n, self.one, self.back, self.level = (self.lookup.spread(x) for x in (n[first].astype(np.float32), *rate))

    def find(self, context: np.ndarray, id_: np.ndarray) -> np.ndarray:
        return self.lookup.find(Followers.key(context, id_))


def facts(batch: pa.RecordBatch) -> list[Facts | None]:
    """Facts of pairs and of spellings."""
    if "facts" not in batch.schema.names:
        return [None, None]
    context, what, n, figures = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in batch.column("facts").flatten().flatten())
    kind, context, rest = what & 1, context.view(U64), (what >> 1, n, figures >> KINDS_BITS, figures & (1 << KINDS_BITS) - 1)
    with np.errstate(over="ignore"):
        return [Facts(c(context[kind == k]), *[x[kind == k] for x in rest]) for k, c in enumerate((mix, np.array))]


class Followers:
    """Counts of ids after contexts, as probabilities that fall back on others (Witten-Bell).

    total and kinds are those of each row's context over all counts, kept here or not; left out, all are here.
    """

    def __init__(self, context: np.ndarray, id_: np.ndarray, n: np.ndarray, total: np.ndarray | None = None, kinds: np.ndarray | None = None, every: bool = True):
        self.keys, self.n, self.every = self.key(context, id_), n.astype(np.float32), every
        self.contexts, first, of = np.unique(context, return_index=True, return_inverse=True)
        here = np.bincount(of)
        total, kinds = (np.bincount(of, n), here) if total is None else (total[first], kinds[first])
        self.of = of.astype(np.int32)
        one, back, level = rates(total, kinds)
        # the last row is that of contexts never met: all is fallen back on
        self.one, self.back, self.level = np.append(one, np.float32(0)), np.append(back, np.float32(1)), np.append(level, np.uint8(1))
        # whether all counts of a context are here, so that what is not found was never seen
        self.whole = np.append(here == kinds, every)

    @staticmethod
    def key(context: np.ndarray, id_: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (context ^ (id_.astype(np.int64).view(U64) << U64(40))) * U64(BASE)

    def open(self) -> None:
        """Lays the table out for at(); what it is made from goes."""
        self.context, self.pair = Lookup(self.contexts), Lookup(self.keys)
        self.of_slot, self.n_slot = self.pair.spread(self.of), self.pair.spread(self.n)
        self.context_slot = self.context.spread(np.arange(len(self.contexts), dtype=np.int32))
        del self.contexts, self.keys, self.of, self.n, self.context.slot, self.pair.slot

    def _of(self, context: np.ndarray) -> np.ndarray:
        slot = self.context.find(context)
        return np.where(slot >= 0, self.context_slot[slot], -1)

    def open_questions(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of counts that this table cannot tell, and those among them whose context it does not know."""
        miss = np.flatnonzero(self.pair.find(self.key(context, target)) < 0)
        of = self._of(context[miss])
        ask = ~np.take(self.whole, of, mode="wrap")
        return miss[ask], miss[ask & (of < 0)]

    def at(self, context: np.ndarray, target: np.ndarray, other: np.ndarray, own: Facts | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the targets, where the others are what is fallen back on, and how sure the contexts are."""
        p, level = np.empty(len(target), np.float32), np.empty(len(target), np.uint8)
        for a in range(0, len(target), SLICE):
            part = slice(a, a + SLICE)
            here, there = context[part], target[part]
            place = self.pair.find(self.key(here, there))
            met = place >= 0
            of, n = np.full(len(here), -1, np.int32), np.zeros(len(here), np.float32)
            of[met], n[met] = self.of_slot[place[met]], self.n_slot[place[met]]
            rest = np.flatnonzero(~met)
            of[rest] = self._of(here[rest])
            one, back, sure = (np.take(x, of, mode="wrap") for x in (self.one, self.back, self.level))
            if own is not None:
                rest = rest[~np.take(self.whole, of[rest], mode="wrap")]
                slot = own.find(here[rest], there[rest])
                alone = np.flatnonzero((slot < 0) & (of[rest] < 0))
                slot[alone] = own.find(here[rest[alone]], np.full(len(alone), NO_ID))
                rest, slot = rest[slot >= 0], slot[slot >= 0]
                n[rest], one[rest], back[rest], sure[rest] = own.n[slot], own.one[slot], own.back[slot], own.level[slot]
            p[part] = n * one + back * other[part]
            level[part] = sure
        return p, level


#: Stands for a context's own figures where facts are asked for.
NO_ID = -1
#: A context's number of kinds, a vocabulary's length at most, lies below its total in one number: few columns move in shuffles.
KINDS_BITS = 20


class Frequencies:
    """What the training ids tell: unigrams, ids after the last one, ids in their words, and the embedding row of each id."""

    def __init__(self, unigrams: np.ndarray, pairs: tuple, spellings: tuple, ends: np.ndarray):
        size = len(unigrams)
        self.start, self.ends = size, ends
        self.unigram = ((unigrams + FLOOR) / (unigrams.sum() + FLOOR * size)).astype(np.float32)
        with np.errstate(over="ignore"):
            self.pairs = Followers(mix(pairs[0].astype(U64)), *pairs[1:])
            self.of_id = mix(np.arange(size + 1).astype(U64))
        self.spellings = Followers(*spellings)
        self.often = np.append(np.argsort(-unigrams, kind="stable")[: TOP - 1], size)
        self.row = (ROWS - SHARED + np.arange(size + 1) * 0x9E3779B1 % 2**32 % SHARED).astype(np.int64)
        often = np.argsort(-unigrams, kind="stable")[: ROWS - SHARED - 1]
        self.row[often] = np.arange(len(often))
        self.row[size] = ROWS - SHARED - 1

    def open(self, squared: bool = True) -> None:
        """Lays the tables out; squared: with the square, which a task that looks up few ids does not need."""
        if not hasattr(self, "opened"):
            self.pairs.open()
            self.spellings.open()
            self.opened = True
        if not squared or hasattr(self, "square"):
            return
        # pairs of the most frequent ids, and of the start with these, are read off a square
        n = len(self.often)
        self.place = np.full(self.start + 1, n, np.int32)
        self.place[self.often] = np.arange(n)
        square = np.zeros((n, n), np.float32)
        for a in range(0, n, 32):
            last, target = (x.ravel() for x in np.meshgrid(self.often[a : a + 32], self.often[:-1], indexing="ij"))
            p = self.pairs.at(np.take(self.of_id, last), target, np.take(self.unigram, target))[0]
            p[self.pairs.open_questions(np.take(self.of_id, last), target)[0]] = np.nan
            square[a : a + 32, :-1] = p.reshape(-1, n - 1)
        self.square = square.ravel()

    def _squared(self, last: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by pairs as the square has them, and the places where it has none."""
        n = len(self.often)
        a, b = np.take(self.place, last), np.take(self.place, target)
        p = np.take(self.square, a * n + b, mode="clip")
        return p, np.flatnonzero((np.maximum(a, b) == n) | np.isnan(p))

    def at(self, last: np.ndarray, target: np.ndarray, own: list[Facts | None] = (None, None)) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each target by pairs and by spellings, and how sure the latter are (0 at a word's beginning)."""
        p, rest = self._squared(last, target)
        p[rest] = self.pairs.at(self.of_id[last[rest]], target[rest], self.unigram[target[rest]], own[0])[0]
        given, level = np.stack((p, p), axis=1), np.zeros(len(last), np.uint8)
        with np.errstate(over="ignore"):
            inside, context = spelled(last, self.ends)
        given[inside, 1], level[inside] = self.spellings.at(context, target[inside], p[inside], own[1])
        return given, level

    def open_questions(self, last: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(place, kind, context, id) of the counts that the tables here cannot tell; NO_ID asks for a context itself."""
        rest = np.arange(len(last))
        with np.errstate(over="ignore"):
            inside, spelling = spelled(last, self.ends)
        out = []
        for kind, at, table, context, shown in ((0, rest, self.pairs, self.of_id[last[rest]], last[rest].astype(U64)), (1, inside, self.spellings, spelling, spelling)):
            ask, alone = table.open_questions(context, target[at])
            both = np.concatenate((ask, alone))
            out.append((at[both], np.full(len(both), kind), shown[both], np.concatenate((target[at[ask]], np.full(len(alone), NO_ID)))))
        return tuple(np.concatenate(x) for x in zip(*out))


class Texts:
    """The ids of a batch's texts in a row, with what the frequencies tell of them, and windows on them."""

    def __init__(self, freq: Frequencies, batch: pa.RecordBatch):
        self.last, self.target, self.head, self.length = streams(batch, freq.start)
        self.given, self.level = freq.at(self.last, self.target, facts(batch))
        self.row = np.take(freq.row, self.last)
        # where the same id stood before
        order = np.argsort(self.target.astype(np.uint16), kind="stable")
        self.before = np.full(len(order), -1)
        again = self.target[order[1:]] == self.target[order[:-1]]
        self.before[order[1:][again]] = order[:-1][again]

    def window(self, begin: np.ndarray, start: int = 0) -> tuple:
        """What forward() needs of windows that begin at these places, from their place start on."""
        place = np.minimum(begin[:, None] + np.arange(WIDTH), len(self.last) - 1)
        own = place[:, start:].ravel()
        low = np.repeat(begin, WIDTH - start)
        at = np.take(self.before, own)
        of = np.flatnonzero(at >= low)
        at, hits, ofs = at[of], [], []
        while len(of):
            hits.append(of * WIDTH + at - low[of])
            ofs.append(of)
            at = self.before[at]
            more = at >= low[of]
            of, at = of[more], at[more]
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return np.take(self.row, place), np.take(self.given, own, axis=0), np.take(self.level, own), join(hits), join(ofs)


#: Places looked up at once, so that what is at work stays in the cache.
SLICE = 1 << 14
def windows(length: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and first place of windows of WIDTH places that begin every so many, up to each text's end."""
    each = np.maximum(1, -(-(length - WIDTH) // step) + 1)
    return np.repeat(np.arange(len(each)), each), (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * step


#: How sure spellings can be; the parts that are mixed.
LEVELS, PARTS = 62, 3
SHAPES = {"emb": (ROWS, DIM), "pos": (WIDTH, DIM), "qk": (DIM, 2 * DIM), "level": (LEVELS, PARTS)}


def start_model() -> dict[str, np.ndarray]:
    """Places attend to equal ids before the training has begun."""
    rng = np.random.Generator(np.random.PCG64(5))
    model = {name: (rng.standard_normal(shape) * 0.1).astype(np.float32) for name, shape in SHAPES.items()}
    model["emb"] *= 10
    model["pos"] *= 0
    model["qk"][:] = np.tile(np.eye(DIM, dtype=np.float32), 2) * 0.7
    model["level"][:] = -0.5, 1, -1
    return model


def flat(model: dict) -> np.ndarray:
    return np.concatenate([model[name].ravel() for name in SHAPES])


def shaped(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in SHAPES.items():
        n = int(np.prod(shape))
        out[name] = values[at : at + n].reshape(shape).astype(np.float32)
        at += n
    return out


_MASK = np.tril(np.ones((WIDTH, WIDTH), np.float32), -1)
_ONES, _WIDE = np.ones(PARTS, np.float32), np.ones(WIDTH, np.float32)
#: Attention scores stay under this, so that exponentials need no shift.
BOUND = np.float32(30)


def forward(model: dict, row: np.ndarray, given: np.ndarray, level: np.ndarray, hit: np.ndarray, of: np.ndarray, start: int = 0):
    """Log probabilities of the ids that follow the places of each window, from place start on, and what the gradient needs.

    The arguments are those of Texts.window(): embedding rows (windows x WIDTH), and for the places from start on the
    probabilities given, their level, and where in the attention matrix (hit, of place of) an id stands that follows too.
    """
    size = len(row)
    x = np.take(model["emb"], row, axis=0)
    x += model["pos"]
    qk = (x.reshape(-1, DIM) @ model["qk"]).reshape(size, WIDTH, 2 * DIM)
    q = np.ascontiguousarray(qk[:, start:, :DIM])
    k = np.ascontiguousarray(qk[..., DIM:].transpose(0, 2, 1))
    a = q @ k
    if a.size and a.max() > BOUND:
        np.minimum(a, BOUND, out=a)
    np.exp(a, out=a)
    a *= _MASK[start:]
    scale = 1 / (a.reshape(-1, WIDTH) @ _WIDE + 1)
    copy = ((np.bincount(of, np.take(a, hit), minlength=len(scale)) + given[:, -1]) * scale).astype(np.float32)
    shares = np.exp(np.clip(model["level"], -BOUND, BOUND))
    shares /= shares.sum(axis=1, keepdims=True)
    g = np.take(shares, level, axis=0)
    parts = g * np.concatenate((given, copy[:, None]), axis=1)
    p = parts @ _ONES
    return np.log(p).reshape(size, -1), (x, q, k, a, scale, copy, g, parts, p)


def gradient(model: dict, row: np.ndarray, level: np.ndarray, hit: np.ndarray, of: np.ndarray, saved, counted: np.ndarray) -> dict[str, np.ndarray]:
    """Gradient of the counted log probabilities; saved is of a whole forward()."""
    x, q, k, a, scale, copy, g, parts, p = saved
    out = {}
    weight = counted.ravel() / p
    dg = (parts - g * p[:, None]) * weight[:, None]
    out["level"] = np.bincount(np.take(_PARTS, level, axis=0).ravel(), dg.ravel(), minlength=LEVELS * PARTS).astype(np.float32).reshape(LEVELS, PARTS)
    # of a weight before its exponential: what it adds where it hits, less what it takes from all copies
    pull = g[:, -1] * weight * scale
    ds = a * (-pull * copy).reshape(len(row), WIDTH, 1)
    ds.ravel()[hit] += np.take(a, hit) * pull[of]
    dq, dk = (ds @ k.transpose(0, 2, 1)).reshape(-1, DIM), (ds.transpose(0, 2, 1) @ q).reshape(-1, DIM)
    flat_x = x.reshape(-1, DIM).T
    out["qk"] = np.concatenate((flat_x @ dq, flat_x @ dk), axis=1)
    dx = dq @ model["qk"][:, :DIM].T
    dx += dk @ model["qk"][:, DIM:].T
    out["pos"] = dx.reshape(x.shape).sum(axis=0)
    at = np.take(_CELLS, row.ravel(), axis=0)
    out["emb"] = np.bincount(at.ravel(), dx.ravel(), minlength=ROWS * DIM).astype(np.float32).reshape(ROWS, DIM)
    return out


#: Places of each embedding row in the flat table.
_CELLS = np.arange(ROWS * DIM).reshape(ROWS, DIM)
#: And of each level's parts.
_PARTS = np.arange(LEVELS * PARTS).reshape(LEVELS, PARTS)


def _trainer(values: np.ndarray, shared: Broadcast):
    """One task's pass over its texts from the common model; yields its parameters times the ids it has seen."""

    def run(batches):
        freq = shared.value
        model = shaped(values)
        past = {k: np.full_like(w, 1e-6) for k, w in model.items()}  # squares of the gradients so far
        seen = 0
        freq.open()
        for batch in batches:
            if not len(batch):
                continue
            texts = Texts(freq, batch)
            doc, off = windows(texts.length, WIDTH)
            for rows in np.array_split(np.arange(len(doc)), max(1, round(len(doc) / BATCH))):
                d, at = doc[rows], off[rows]
                row, given, level, hit, of = texts.window(texts.head[d] + at)
                counted = (np.arange(WIDTH) < (texts.length[d] - at)[:, None]).astype(np.float32)
                saved = forward(model, row, given, level, hit, of)[1]
                for name, g in gradient(model, row, level, hit, of, saved, counted / counted.sum()).items():
                    past[name] += g * g
                    g *= RATE
                    g /= np.sqrt(past[name])
                    model[name] += g
            seen += len(texts.target)
        if seen:
            p = np.concatenate((flat(model).astype(np.float64), [1.0])) * seen
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(p), dtype=np.int32)), pa.array(p)], names=["i", "p"])

    return run


def frequencies(training: DataFrame, path: str) -> tuple[Frequencies, DataFrame | None]:
    """Counts over all ids of the training texts: those that travel, and a table of the others, None if all travel.

    Its rows are (context, what, n, figures): what is twice the id, with 1 added for spellings, figures the context's total and kinds.
    """
    size, ends = vocabulary(path), word_ends(path)

    def counted(within: bool) -> DataFrame:
        """(context, id, n, total, kinds, top): with each count its context's sum, number and largest of counts, and whether the row is its context's first."""
        # dealt by context once: neither the sums nor the figures move the counts again; a task sums its own first
        counts = training.mapInArrow(_id_counts(size, ends, within), "context long, id int, n long").repartition("context").groupBy("context", "id").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("context")  # a vocabulary's length at most
        figures = {"total": F.sum("n").over(w), "kinds": F.count(F.lit(1)).over(w), "top": F.max("n").over(w), "first": F.col("id") == F.min("id").over(w)}
        return written(counts.withColumns(figures), "counts")

    def kept(counts: DataFrame, low: int) -> tuple:
        got = counts.where(level("n") >= low).orderBy("context", "id").toArrow()
        column = lambda c: got.column(c).to_numpy()
        return column("context").view(U64), *map(column, ("id", "n", "total", "kinds")), got.num_rows == counts.count()

    def others(kind: int, counts: DataFrame, low: int) -> DataFrame:
        few = counts.where(level("n") < low).select("context", "id", "n", "total", "kinds")
        contexts = counts.where(F.col("first") & (level("top") < low)).select("context", F.lit(NO_ID).alias("id"), F.lit(0).cast("long").alias("n"), "total", "kinds")
        figures = F.shiftleft("total", KINDS_BITS).bitwiseOR(F.col("kinds"))
        return few.unionAll(contexts).select("context", (2 * F.col("id") + kind).alias("what"), "n", figures.alias("figures"))

    pairs, spellings, one = counted(False), counted(True), np.zeros(size)
    for r in pairs.groupBy("id").agg(F.sum("n").alias("n")).collect():  # a vocabulary's length at most
        one[r.id] = r.n
    low = lowest(pairs, "n", PAIRS), lowest(spellings, "n", SPELLINGS)
    freq = Frequencies(one, kept(pairs, low[0]), kept(spellings, low[1]), ends)
    if freq.pairs.every and freq.spellings.every:
        return freq, None
    return freq, others(0, pairs, low[0]).unionAll(others(1, spellings, low[1]))


def _asked(shared: Broadcast):
    """(row, context, what): each count once that a text needs and the tasks' tables cannot tell."""

    def run(batches):
        freq = shared.value
        freq.open(squared=False)
        for batch in batches:
            if not len(batch):
                continue
            last, target, _, length = streams(batch, freq.start)
            place, kind, context, id_ = freq.open_questions(last, target)
            if "held" in batch.schema.names:
                # a training text was counted: each of its ids tells of its context too
                ask = np.repeat(batch.column("held").to_numpy(zero_copy_only=False), length)[place] | (id_ != NO_ID)
                place, kind, context, id_ = place[ask], kind[ask], context[ask], id_[ask]
            row = np.repeat(batch.column("row").to_numpy(), length)[place]
            what = 2 * id_.astype(np.int64) + kind
            with np.errstate(over="ignore"):
                mark = mix(context + mix(what.view(U64))) ^ mix(row.view(U64))
            _, first = np.unique(mark, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(row[first]), pa.array(context[first].view(np.int64)), pa.array(what[first].astype(np.int32))], names=["row", "context", "what"])

    return run


def with_facts(ids: DataFrame, freq: Frequencies | Broadcast, counts: DataFrame | None) -> DataFrame:
    """ids (row, ids and others), each with the counts its text needs besides those that travel."""
    if counts is None:
        return ids
    shared = freq if isinstance(freq, Broadcast) else ids.sparkSession.sparkContext.broadcast(freq)
    asked = ids.select(*[c for c in ids.columns if c in ("row", "ids", "held")]).mapInArrow(_asked(shared), "row long, context long, what int")
    told = asked.join(counts, ["context", "what"])  # what was never seen in training has no count
    own = told.groupBy("row").agg(F.collect_list(F.struct("context", "what", "n", "figures")).alias("facts"))  # of one text
    return written(ids.join(own, "row", "left"), "facts")


def train(ids: DataFrame, path: str | None = None) -> tuple[np.ndarray, Broadcast, DataFrame]:
    """(parameters, frequencies, ids with facts) learned from all the training documents of subword_ids(), whose rows are numbered.

    The frequencies are broadcast as an object, so that a worker lays them out once and keeps them for its later tasks.
    """
    freq, counts = frequencies(ids.where("not held").select("ids"), path or tokenizer_path(TOKENIZER))
    shared = ids.sparkSession.sparkContext.broadcast(freq)
    full = with_facts(ids, shared, counts)
    if counts is not None:  # all that is read from here on lies in the table with facts
        discard(counts, "counts")
        discard(ids, "ids")
    ids, values = full, flat(start_model())
    training = ids.where("not held").select(*[c for c in ids.columns if c in ("ids", "facts")])
    got = training.mapInArrow(_trainer(values, shared), "i int, p double").groupBy("i").agg(F.sum("p").alias("p")).toArrow()
    if len(got):
        p = np.zeros(len(values) + 1)
        p[got.column("i").to_numpy()] = got.column("p").to_numpy()
        values = p[:-1] / p[-1]
    return values, shared, ids


def _scorer(values: np.ndarray, shared: Broadcast):
    def run(batches):
        model, freq = shaped(values), shared.value
        freq.open()
        for batch in batches:
            if not len(batch):
                continue
            texts = Texts(freq, batch)
            doc, off = windows(texts.length, STEP)
            total = np.zeros(len(batch))
            # first windows score all their places, later ones those after the overlap
            for rows, start in ((np.flatnonzero(off == 0), 0), (np.flatnonzero(off > 0), WIDTH - STEP)):
                for s in range(0, len(rows), BATCH):
                    d, at = doc[rows[s : s + BATCH]], off[rows[s : s + BATCH]]
                    log_p = forward(model, *texts.window(texts.head[d] + at, start), start)[0]
                    counted = np.arange(start, WIDTH) < (texts.length[d] - at)[:, None]
                    total += np.bincount(d, np.where(counted, log_p, 0).sum(axis=1, dtype=np.float64), minlength=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(np.round(total / np.log(10), 4))], names=["doc_id", "text_hash", "score"])

    return run


def lm_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    prepared(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("held", held)
    counts = written(word_counts(text.where("not held")), "words")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    hot = most(counts.where(F.col("h") != END_HASH), "c", HOT).toArrow()
    words = docs.sparkSession.sparkContext.broadcast(Words(hot.column("h").to_numpy().view(U64), hot.column("c").to_numpy(), total, distinct))
    ids = written(subword_ids(text, tokenizer_path(TOKENIZER)).withColumn("row", F.monotonically_increasing_id()), "ids")
    values, shared, ids = train(ids)
    scores = ids.select("doc_id", "text_hash", *[c for c in ids.columns if c in ("ids", "facts")]).mapInArrow(_scorer(values, shared), "doc_id long, text_hash long, score double")
    parts = text.select("doc_id", "text").mapInArrow(
        _base_parts(words),
        "doc_id long, text_hash long, n_tokens long, hot_known long, hot_score double, rest array<long>, times array<long>",
    )
    parts = written(parts, "parts")
    floor = float(total) + 0.1 * (distinct + 1)
    rest = parts.select("doc_id", "text_hash", F.explode(F.arrays_zip("rest", "times")).alias("w")).select("doc_id", "text_hash", F.col("w.rest").alias("h"), F.col("w.times").alias("times"))
    met = rest.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    value = F.col("times") * F.log10((F.col("c") + 0.1) / F.lit(floor))
    sums = met.select("doc_id", "text_hash", value.alias("rest_score"), F.when(F.col("c") > 0, F.col("times")).otherwise(0).cast("long").alias("rest_known"))
    # what belongs to a text comes together once; equal rows have equal results, and a null doc_id is a value of its own
    own = parts.drop("rest", "times").withColumn("rows", F.lit(1).cast("long"))
    every = own.unionByName(sums, allowMissingColumns=True).unionByName(scores, allowMissingColumns=True)
    at = every.groupBy("doc_id", "text_hash").agg(*[F.max(c).alias(c) for c in ("n_tokens", "hot_known", "hot_score", "score")], *[F.sum(c).alias(c) for c in ("rows", "rest_score", "rest_known")])
    at = at.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    end_c = counts.where(F.col("h") == END_HASH).first()
    end = float(np.log10((end_c.c + 0.1) / floor)) if end_c else None
    share = lambda c: F.coalesce(F.col(c) / F.col("rows"), F.lit(0.0))
    base = F.lit(end).cast("double") + F.col("hot_score") + share("rest_score")
    known = F.col("hot_known") + F.round(share("rest_known")).cast("long") + F.lit(1 if end_c else 0)
    return at.select("doc_id", held.alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(prepared(spark), sf_dir, "documents"))
