"""Garbled text from wrong character encoding: learned from near-twins, applied to all records.

1. Texts are cut into passages (sentences and lines). A passage with non-ASCII characters has a skeleton - the passage
   without them, with numbers and hexadecimal strings made alike, of which a 128-bit hash is kept - and its runs of
   non-ASCII characters. One pass over all texts counts the different texts that hold each (skeleton, runs), and the
   pairs of neighbouring characters with a non-ASCII one, each different passage weighing as the bits of its number of
   different texts. So copies of a garbled text, which may differ in layout and markup, neither make its characters usual
   nor itself the clean twin.
2. The most frequent runs of a skeleton are its clean twin. Rare runs are joined with it on the skeleton and aligned,
   run by run and character by character (``align``): each clean character is paired with the characters it became.
   Where a usual chain of encodings turns the twin's runs into the rare ones, for enough characters, the chain is learned.
   All other aligned pairs are counted; a pair of any two encodings known to Python that explains several of them is
   learned, too, and so stands for characters not yet seen; what is still left, if seen often enough and odder than the
   clean character, is a learned table of characters.
3. Every record is then read again with the learned chains and the table. A passage is garbled if undoing one of them on
   runs inside words makes their characters far more probable, by the counts of pass 1, or if replacement signs stand
   inside words. Passages with odd runs only between words are compared with their clean twin by a join on the
   skeleton, so a sound text that quotes a garbled sequence is none; neither is a twin that is such a sequence itself.

All counts cover all texts. Texts that differ in their letters or digits count as different ones. A passage that very
many texts share is a hot key of the joins, which treat it apart. What goes to the driver and to every task is bounded by
alphabets, not by data: chains by the number of encodings, the table by characters times encodings, and character
counts by pairs of signs, of which there are some four thousand (``_sign``); a corpus in a few dozen languages has some
hundred thousand such pairs, 100 bytes each.

Defined cases: null and empty texts are sound. A text is judged by all its passages. Text whose characters were lost
(replacement signs) is restored from its clean twin if it has one, else reported with null in their place. Text that
lost ASCII characters, too, as when letters were read as halves of others, has no twin.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainweft.llm import codecs as codings
from chainweft.operators.skew import lookup
from chainweft.operators.spread import spread
from chainweft.session import WrittenTables

#: A rare variant is learned from if the twin occurs at least so many times as often, and at least so often at all.
TWIN_RATIO, TWIN_LEAST = 3, 3
#: Characters that a chain must explain, over all pairs of a twin and a variant, to be learned.
CHAIN_SUPPORT = 4
#: Natural logarithm of how much more probable a passage must become to count as restored.
LEAST_GAIN = 4.0
#: Weight of the plain frequency of a character against the counts after its predecessor.
BACKOFF = 5.0
#: Different texts in which an aligned pair of characters must occur to be learned.
PAIR_SUPPORT = 3
#: A clean character must be so many times as frequent as what it became, to be learned without a known encoding.
PAIR_RATIO = 3
#: Runs with their neighbours whose readings a task keeps, about 3 KB each.
MOST_KNOWN = 30_000
#: Identifiers of garbled documents that are broadcast to pick out their texts, about 100 bytes each.
MOST_GARBLED = 300_000

PASSAGE = re.compile(r"(?<=[.!?;])\s+|[\r\n]+")
RUN = re.compile(r"[^\x00-\x7f]+")
#: A word with what stands in it for letters, without surrounding quotation marks and punctuation.
WORD = re.compile(r"[^\s\"'“”‘«»(){}\[\],.;:!?]+")
#: What may differ between copies of a text: markup, blanks and ASCII punctuation.
LAYOUT = re.compile(r"<[^<>]*>|[\x00-/:-@\[-`{-\x7f]+")
HEX, NUMBER, BLANKS = re.compile(r"0[xX][0-9a-fA-F]+"), re.compile(r"\d+"), re.compile(r"\s+")
SEPARATOR = "\x1f"


def skeleton(passage: str) -> bytes:
    """A hash of the passage without its non-ASCII characters, numbers and hexadecimal strings made alike."""
    plain = BLANKS.sub(" ", RUN.sub("", passage)).strip()
    return xxhash.xxh3_128_digest(NUMBER.sub("0", HEX.sub("H", plain)))


def runs_of(passage: str) -> str:
    return SEPARATOR.join(RUN.findall(passage))


def _sign(c: str) -> str:
    """The character as the model counts it: Latin, Greek, Cyrillic, Armenian, Hebrew and signs each, others by blocks."""
    if c.isascii():
        return "0" if c.isdigit() else " " if c.isspace() else c
    code = ord(c)
    if code >= 0x2600:
        return chr(code & ~0x3FF)
    return chr(code & ~0x1F) if 0x600 <= code < 0x2000 else c


def _ends(passage: str) -> str:
    """The signs before and after each run, a blank for none."""
    beside = lambda at: _sign(passage[at]) if 0 <= at < len(passage) else " "
    return "".join(beside(m.start() - 1) + beside(m.end()) for m in RUN.finditer(passage))


def _pairs(runs: str, ends: str) -> Iterator[tuple[str, str]]:
    """Neighbouring characters of which at least one isn't ASCII."""
    for k, run in enumerate(runs.split(SEPARATOR)):
        signs = [ends[2 * k], *map(_sign, run), ends[2 * k + 1]]
        yield from zip(signs, signs[1:])


def _mark(text: str) -> int:
    """A hash of the text without regard to layout, markup and letter case."""
    return xxhash.xxh64_intdigest(LAYOUT.sub("", text).lower()) - (1 << 63)


def _passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(skeleton, runs, ends, mark of the passage, mark of the text), each once in a batch."""
    for batch in batches:
        seen: dict[tuple, None] = {}
        for text in batch.column(0).to_pylist():
            if text and not text.isascii():
                whole = _mark(text)
                for passage in PASSAGE.split(text):
                    if passage and not passage.isascii():
                        seen[skeleton(passage), runs_of(passage), _ends(passage), _mark(passage), whole] = None
        if seen:
            columns = zip(("one", "two", "ends", "passage", "text"), zip(*seen))
            kinds = {"one": pa.binary(), "two": pa.string(), "ends": pa.string()}
            yield pa.record_batch({c: pa.array(v, kinds.get(c, pa.int64())) for c, v in columns})


def _weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights of character pairs, folded over each batch."""
    for batch in batches:
        seen: Counter = Counter()
        for runs, ends, weight in zip(*(batch[c].to_pylist() for c in ("two", "ends", "weight"))):
            for pair in _pairs(runs, ends):
                seen[pair] += weight
        if seen:
            one, two = zip(*seen)
            yield pa.record_batch({"one": pa.array(one), "two": pa.array(two), "n": pa.array(list(seen.values()), pa.int64())})


def explains(chain: codings.Chain, clean: list[str], odd: list[str]) -> bool:
    """Whether the chain turns the clean runs into the odd ones, at least one of them changed."""
    return len(clean) == len(odd) and clean != odd and all(codings.garble(c, chain) == o for c, o in zip(clean, odd))


def lost(clean: list[str], odd: list[str]) -> bool:
    """Whether the odd runs are the clean ones with every character or byte made a replacement sign."""
    mark = codings.REPLACEMENT
    return len(clean) == len(odd) and clean != odd and any(all(o == mark * size(c) for c, o in zip(clean, odd)) for size in (len, lambda c: len(c.encode())))


def align(clean: list[str], odd: list[str]) -> dict[str, str] | None:
    """What each character of the clean runs became in the odd ones; None if no one mapping explains them.

    Lengths are tried in turn: one character for each, as many as the character has bytes in UTF-8, and else whatever
    runs of which all but one character are known leave for that one, or one character for each of those left.
    """
    if len(clean) != len(odd):
        return None
    runs = [(c, o) for c, o in zip(clean, odd) if c != o]  # a text may be garbled in part
    if not runs:
        return None
    for size in (lambda c: 1, lambda c: len(c.encode("utf-8", "surrogatepass"))):
        if all(sum(map(size, c)) == len(o) for c, o in runs):
            found: dict[str, str] = {}
            for c, o in runs:
                at = 0
                for x in c:
                    piece = o[at : at + size(x)]
                    at += size(x)
                    if found.setdefault(x, piece) != piece:
                        found = {}
                        break
                else:
                    continue
                break
            if found:
                return found
    found = {}
    while True:
        more, sure, even = False, True, None
        for c, o in runs:
            while c and c[0] in found and o.startswith(found[c[0]]):
                c, o = c[1:], o[len(found[c[0]]) :]
            while c and c[-1] in found and o.endswith(found[c[-1]]):
                c, o = c[:-1], o[: len(o) - len(found[c[-1]])]
            if not c and not o:
                continue
            sure = False
            if c and len(set(c)) == 1 and c[0] not in found and o and len(o) % len(c) == 0 and o == o[: len(o) // len(c)] * len(c):
                found[c[0]], more = o[: len(o) // len(c)], True
            elif c and len(c) == len(o):
                even = c, o
        if sure:
            return found
        if not more and (even is None or found.setdefault(even[0][0], even[1][0]) != even[1][0]):
            return None


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Characters that each usual chain explains in pairs of a twin's runs and a variant's, and what others became.

    A pair of characters counts by the different texts of the variant, where at least two different ones were aligned
    at once, none was lost, and no clean run is itself UTF-8 that was misread.
    """
    every = codings.chains()
    misread = [chain for chain in every if chain[0][0] == "utf-8"]
    for batch in batches:
        votes: Counter = Counter()
        for clean, odd, texts in zip(*(batch[c].to_pylist() for c in ("ref", "two", "n"))):
            clean, odd = clean.split(SEPARATOR), odd.split(SEPARATOR)
            weight = sum(map(len, clean))
            held = [k for k, chain in enumerate(every) if explains(chain, clean, odd)]
            votes.update({(k, "", ""): weight for k in held})
            if not held and not any(codings.restore(c, chain) for chain in misread for c in clean):
                changed = {(c, o) for c, o in (align(clean, odd) or {}).items() if c != o}
                if len(changed) > 1 and not any(codings.REPLACEMENT in o for _, o in changed):
                    votes.update({(-1, c, o): texts for c, o in changed})
        if votes:
            chain, one, two = zip(*votes)
            yield pa.record_batch({"chain": pa.array(chain, pa.int32()), "one": pa.array(one), "two": pa.array(two), "n": pa.array(list(votes.values()), pa.int64())})


class Reader:
    """Judges passages by the learned chains, the learned table and the character model.

    The table counts as one more chain, after the others.
    """

    def __init__(self, learned: list[codings.Chain], pairs: dict[tuple[str, str], int], table: dict[str, list[str]]):
        self.learned, self.pairs, self.table = learned, pairs, table
        #: pieces of the table by their first character, the longest first
        self.pieces: dict[str, list[str]] = {}
        for piece in sorted(table, key=len, reverse=True):
            self.pieces.setdefault(piece[0], []).append(piece)
        self.after: Counter = Counter()
        self.single: Counter = Counter()
        for (a, b), n in pairs.items():
            self.after[a] += n
            self.single[b] += n
        self.total = sum(self.single.values()) or 1
        #: blocks of 64 characters that occur
        self.scripts = {ord(b) >> 6 for b in self.single}
        self.known: dict[tuple[str, str, str], list] = {}
        #: the largest gain among the readings in ``known``, by their identity
        self.most: dict[int, float] = {}
        #: for each character a bit for every chain that may have made it
        self.makers: Counter = Counter()
        #: chains whose characters are too many to list
        self.any = 0
        for k, chain in enumerate(learned):
            made = codings.readable(chain)
            if made is None:
                self.any |= 1 << k
            for c in made or ():
                self.makers[c] |= 1 << k

    def _step(self, a: str, b: str) -> float:
        """What sign ``b`` costs after sign ``a``."""
        plain = (self.single.get(b, 0) + 0.1) / (self.total + 1000)
        return -math.log((self.pairs.get((a, b), 0) + BACKOFF * plain) / (self.after.get(a, 0) + BACKOFF))

    def _cost(self, text: str) -> float:
        signs = [_sign(c) for c in text]
        return sum(map(self._step, signs, signs[1:]))

    def _by_table(self, before: str, run: str, after: str) -> str | None:
        """The most probable reading of a run by the table, characters that it doesn't explain staying; None without any."""
        if not any(c in self.pieces for c in run):
            return None
        ways: list[dict[str, tuple[float, str]]] = [{} for _ in range(len(run) + 1)]
        ways[0][before] = (0.0, "")
        for at, c in enumerate(run):
            steps = [(1, c)] + [(len(p), clean) for p in self.pieces.get(c, ()) if run.startswith(p, at) for clean in self.table[p]]
            for last, (cost, text) in ways[at].items():
                for size, clean in steps:
                    sign = _sign(clean)
                    new = (cost + self._step(last, sign), text + clean)
                    held = ways[at + size].get(sign)
                    if held is None or new < held:
                        ways[at + size][sign] = new
        return min((cost + self._step(last, after), text) for last, (cost, text) in ways[-1].items())[1]

    def _readings(self, before: str, run: str, after: str) -> list[tuple[int, str, float, int]]:
        """(chain, restored run, gain, whether the run is inside a word or is one) for every learned chain that may hold."""
        key = (before, run, after)
        if key not in self.known:
            if len(self.known) > MOST_KNOWN:
                self.known.clear()
                self.most.clear()
            makers = -1
            for c in run:
                makers &= self.makers[c]
            makers |= self.any | (1 << len(self.learned) if self.pieces else 0)
            costs: dict[str, float] = {}
            out = []
            while makers:
                low = makers & -makers
                makers ^= low
                k = low.bit_length() - 1
                clean = codings.restore(run, self.learned[k]) if k < len(self.learned) else self._by_table(before, run, after)
                if clean is not None and clean != run:
                    for text in (run, clean):
                        if text not in costs:
                            costs[text] = self._cost(before + text + after)
                    inside = 2 if before.isalnum() or after.isalnum() else int(len(clean) > 1 and clean.isalpha())
                    out.append((k, clean, costs[run] - costs[clean], inside))
            self.known[key] = out
            self.most[id(out)] = max((more for _, _, more, _ in out), default=-math.inf)
        return self.known[key]

    def _undone(self, passage: str, chain: int) -> str:
        """The passage with the chain undone on every run that may have come from it."""
        if chain < len(self.learned):
            return RUN.sub(lambda m: codings.restore(m.group(), self.learned[chain]) or m.group(), passage)
        return RUN.sub(lambda m: self._by_table(*self._beside(passage, m)) or m.group(), passage)

    @staticmethod
    def _beside(passage: str, m: re.Match) -> tuple[str, str, str]:
        """The sign before a run, the run, and the sign after it."""
        before = _sign(passage[m.start() - 1]) if m.start() else " "
        return before, m.group(), _sign(passage[m.end()]) if m.end() < len(passage) else " "

    def is_twin(self, clean: list[str]) -> bool:
        """Whether runs may be a clean twin: none of them, in UTF-8 that a learned chain misread, characters of a script in use."""
        read = (codings.restore(c, chain) for chain in self.learned if chain[0][0] == "utf-8" for c in clean)
        return not any(r is not None and all(ord(x) >> 6 in self.scripts for x in r) for r in read)

    def explained(self, clean: list[str], odd: list[str]) -> bool:
        """Whether a learned chain made the odd runs from the clean ones, or the table most characters of a mapping."""
        if any(explains(chain, clean, odd) for chain in self.learned):
            return True
        changed = [(c, o) for c, o in (align(clean, odd) or {}).items() if c != o] if self.table else []
        return bool(changed) and 2 * sum(c in self.table.get(o, ()) for c, o in changed) >= len(changed)

    def _quoted(self, passage: str, chain: int, text: str) -> bool:
        """Whether the passage has a single odd word and the text shows its sound form beside it, so as to explain it."""
        words = {new for w in WORD.findall(passage) if (new := self._undone(w, chain)) != w}
        return len(words) == 1 and words.pop() in WORD.findall(text)

    def judge(self, passage: str, text: str) -> tuple[str, int]:
        """('found', chain), ('lost', -1), ('ask', -1) where only the twin can tell, or ('sound', -1), for one of the text's passages."""
        gain: Counter = Counter()  # from runs inside words
        every: Counter = Counter()  # from all runs: of chains that read the words alike, the one that reads more wins
        weight: Counter = Counter()  # 2 for a run inside a word, 1 for a word by itself, as a lone one may be a quotation
        odd = gone = False
        hopeful = False
        seen = []
        for m in RUN.finditer(passage):
            before, run, after = self._beside(passage, m)
            if codings.REPLACEMENT in run:
                odd = True
                gone |= before.isalnum() or after.isalnum() or len(run) > 3
            readings = self._readings(before, run, after)
            seen.append(readings)
            hopeful |= self.most[id(readings)] > 0
            odd |= self.most[id(readings)] > -LEAST_GAIN
        # without a reading that makes any run more probable no chain can gain
        for readings in seen if hopeful else ():
            for k, _, more, inside in readings:
                if more > 0:
                    every[k] += more
                if inside:
                    gain[k] += more
                    weight[k] += inside
        best = max((k for k in gain if weight[k] >= 2 and gain[k] >= LEAST_GAIN), key=lambda k: every[k], default=-1)
        if best >= 0 and not self._quoted(passage, best, text):
            return "found", best
        return ("lost", -1) if gone else ("ask", -1) if odd else ("sound", -1)

    def restored(self, passage: str, chain: int) -> str:
        """The passage with the chain undone on every run that may have come from it and doesn't get less probable."""

        def undo(m: re.Match) -> str:
            return next((clean for k, clean, more, _ in self._readings(*self._beside(passage, m)) if k == chain and more > 0), m.group())

        return RUN.sub(undo, passage)


def _judge(model):
    """Passages that aren't sound: (id, place of the passage, state, skeleton, runs, restored)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model.value)
        for batch in batches:
            out: dict[str, list] = {"id": [], "place": [], "state": [], "skeleton": [], "runs": [], "restored": []}
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for i, text in enumerate(texts):
                if not text or text.isascii():
                    continue
                for place, passage in enumerate(PASSAGE.split(text)):
                    if not passage or passage.isascii():
                        continue
                    state, chain = reader.judge(passage, text)
                    if state != "sound":
                        restored = reader.restored(passage, chain) if state == "found" else None
                        for name, value in zip(out, (i, place, state, skeleton(passage), runs_of(passage), restored)):
                            out[name].append(value)
            if out["id"]:
                out["id"] = ids.take(pa.array(out["id"]))
                kinds = {"state": pa.string(), "skeleton": pa.binary(), "runs": pa.string(), "restored": pa.string()}
                yield pa.record_batch({"id": out["id"], "place": pa.array(out["place"], pa.int32()), **{c: pa.array(out[c], kind) for c, kind in kinds.items()}})

    return run


def _ask(model):
    """Decides passages by their clean twin: garbled if what was learned or loss of characters leads from it to them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(*model.value)
        for batch in batches:
            keep = []
            for state, ref, odd in zip(batch["state"].to_pylist(), batch["ref"].to_pylist(), batch["runs"].to_pylist()):
                clean, odd = (ref or "").split(SEPARATOR), odd.split(SEPARATOR)
                same = reader.is_twin(clean) and (lost(clean, odd) or reader.explained(clean, odd))
                keep.append("twin" if same else "lost" if state == "lost" else None)
            columns = {c: batch[c] for c in ("id", "place", "runs", "ref")} | {"state": pa.array(keep, pa.string())}
            table = pa.table(columns)
            yield from table.filter(table["state"].is_valid()).combine_chunks().to_batches()

    return run


def learned_mappings(pairs: DataFrame, counted: dict[tuple[str, str], int]) -> tuple[list[codings.Chain], dict[str, list[str]]]:
    """The chains and the table (what a character became: clean characters) learned from pairs (ref, two, n) of runs."""
    votes = pairs.select("ref", "two", "n").mapInArrow(_learn, "chain int, one string, two string, n long").groupBy("chain", "one", "two").agg(F.sum("n").alias("n"))
    rows = votes.where(F.col("n") >= F.when(F.col("chain") >= 0, CHAIN_SUPPORT).otherwise(PAIR_SUPPORT)).orderBy(F.desc("n"), "chain", "one", "two").collect()
    every = codings.chains()
    learned = [every[r.chain] for r in rows if r.chain >= 0]
    others = {(r.one, r.two): r.n for r in rows if r.chain < 0}
    wide, rest = codings.identify({(c, o): n for (c, o), n in others.items() if not any(codings.garble(c, chain) == o for chain in learned)})
    usual: Counter = Counter()
    for (_, b), n in counted.items():
        usual[b] += n
    table: dict[str, list[str]] = {}
    for clean, odd in rest:
        if clean.isalpha() and usual[_sign(clean)] >= PAIR_RATIO * min(usual[_sign(c)] for c in odd):
            table.setdefault(odd, []).append(clean)
    return learned + wide, table


def garbled_passages(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, state, restored_runs, restored) for each garbled passage of each document.

    ``place`` counts the document's passages from 0. ``restored`` is the passage with a learned chain undone;
    ``restored_runs`` are the twin's runs where the passage was decided by its twin; both are null where the
    characters are lost and there is no twin.
    """
    spark = docs.sparkSession
    tables = WrittenTables(spark, "encoding")
    texts = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")))
    seen = texts.select("text").mapInArrow(_passages, "one binary, two string, ends string, passage long, text long").distinct()
    held = seen.groupBy("one", "two", "ends", "passage").agg(F.count(F.lit(1)).alias("n"))
    counts, _ = tables.write(held.groupBy("one", "two", "ends").agg(F.sum("n").alias("n"), F.sum(F.length(F.bin("n"))).alias("weight")))
    variants, _ = tables.write(counts.groupBy("one", "two").agg(F.sum("n").alias("n")))
    refs, _ = tables.write(variants.groupBy("one").agg(F.max_by("two", F.struct("n", "two")).alias("ref"), F.max("n").alias("ref_n")))
    pairs = lookup(variants, refs, "one", variants.count()).where((F.col("two") != F.col("ref")) & (F.col("ref_n") >= TWIN_LEAST) & (F.col("ref_n") >= TWIN_RATIO * F.col("n")))
    model = counts.select("two", "ends", "weight").mapInArrow(_weigh, "one string, two string, n long").groupBy("one", "two").agg(F.sum("n").alias("n"))
    counted = {(r.one, r.two): r.n for r in model.toLocalIterator()}
    learned, table = learned_mappings(pairs, counted)
    shared = spark.sparkContext.broadcast((learned, counted, table))
    kind = docs.schema[id_col].dataType.simpleString()
    judged, _ = tables.write(texts.mapInArrow(_judge(shared), f"id {kind}, place int, state string, skeleton binary, runs string, restored string"))
    asked = lookup(judged.where(F.col("state").isin("ask", "lost")), refs.select(F.col("one").alias("skeleton"), "ref"), "skeleton", judged.count())
    decided = asked.select("id", "place", "state", "runs", "ref").mapInArrow(_ask(shared), f"id {kind}, place int, runs string, ref string, state string")
    known = judged.where(F.col("state") == "found").select("id", "place", "state", F.lit(None).cast("string").alias("restored_runs"), "restored")
    return known.unionByName(decided.select("id", "place", "state", F.when(F.col("state") == "twin", F.col("ref")).alias("restored_runs"), F.lit(None).cast("string").alias("restored")))


def garbled_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The identifier of each document with a garbled passage, once."""
    return garbled_passages(docs, id_col, text_col).select(F.col("id").alias(id_col)).distinct()


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts restored passages back at their places."""
    for batch in batches:
        texts, whole = [], []
        for text, found in zip(batch["text"].to_pylist(), batch["found"].to_pylist()):
            parts = re.split(f"({PASSAGE.pattern})", text)
            complete = True
            for one in found:
                at, new = 2 * one["place"], one["restored"]
                if new is None and one["restored_runs"] is not None:
                    clean = iter(one["restored_runs"].split(SEPARATOR))
                    new = RUN.sub(lambda _, clean=clean: next(clean), parts[at])
                complete &= new is not None
                parts[at] = parts[at] if new is None else new
            texts.append("".join(parts))
            whole.append(complete)
        yield pa.record_batch({"id": batch["id"], "text": pa.array(texts, pa.string()), "complete": pa.array(whole)})


def restored_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, complete) of each garbled document: its restored text, and whether every garbled passage was.

    The passages of one document are gathered by its identifier, so a group is bounded by one text.
    """
    passages, _ = WrittenTables(docs.sparkSession, "restored").write(garbled_passages(docs, id_col, text_col))
    found = passages.groupBy("id").agg(F.collect_list(F.struct("place", "restored_runs", "restored")).alias("found"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if found.count() <= MOST_GARBLED:  # then sound texts needn't be shuffled
        texts = texts.join(F.broadcast(found.select("id")), "id", "left_semi")
    texts = texts.join(found, "id")
    kind = docs.schema[id_col].dataType.simpleString()
    return texts.select("id", "text", "found").mapInArrow(_rebuild, f"id {kind}, text string, complete boolean").withColumnRenamed("id", id_col)
