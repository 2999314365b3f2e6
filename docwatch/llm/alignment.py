"""Alignment of the tokens of two tokenizers, byte by byte, and how often their ids meet in the corpus.

A is a byte-level BPE (`tokenizers` file), B a SentencePiece BPE with byte fallback. Both cut the same bytes, a space and the text.
Where a token of A and one of B end at the same byte, a group ends; where their byte ranges overlap, they are linked.

1. Tokens, in Arrow inside the tasks: texts are cut into segments, each a space with what follows it (see `segments`), at whose ends both
   tokenizers end a token; distinct segments are encoded once a slice and kept for the next ones. Token lists are taken by segment, flattened, and
   numbered by their parents; cumulative sums of the token lengths less the document's start are the end offsets.
2. An Acero hash join (full outer) on (document, end) brings the ends of both sides together. In the order of the ends, every row is one overlap:
   of the next token of A to end and the next of B. Rows with both are group ends. `Table.group_by` counts the links of a document by id pair.
   A row a document is written, with its distinct pairs and their multiplicities.
3. Partial numbers of documents a pair, by `Table.group_by` in bounded portions of each task, are merged by Spark. Every document's pairs are looked
   up: pairs that very many documents hold from a broadcast of at most HELD rows (counted), the others, of which each is held by few,
   by a shuffled join.

Documents whose text is null or empty, or whose tokens don't spell the bytes (as where a text holds U+2581), have no tokens: all numbers 0, no groups. A segment
is checked once; a document counts only if all its segments spell their bytes. Every row is a document: repeated rows, and rows of one doc_id, count each. A
null doc_id is kept. A text longer than a slice is aligned in several runs of segments, so memory is bounded. An empty table gives an empty result; extra columns
are ignored, whatever their names (the result's columns are fixed).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docwatch.llm.common import cut

#: Where the tokenizers' files are, on the driver and all executors.
FOLDER, BYTES, PIECES = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Segments aligned at once; segments whose tokens a task keeps, of so many characters each on average; new ones encoded in one string.
SLICE, KEPT, SHORT, TOGETHER = 100_000, 400_000, 32, 500
#: Partial counts a task holds before it passes them on; pairs that are broadcast at most.
PARTIAL, HELD = 1_000_000, 500_000

#: Fixed value: the usual rule by which byte-level BPE cuts words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RARE = re.compile(r"[^\x00-\u024F\u2010-\u2027\u20AC]")
_CUT, _JOINED = re.compile(r"(?<=\S) "), re.compile(r"\s ")
_LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def segments(text: str) -> list[str]:
    """The segments of space+text, without their first space: cut before every space that follows another character than white space.

    The byte-level tokenizer's rule starts a new word there, and no piece of B has a space after another character (`Encoder` checks it), so both end a token.
    """
    if text[0] != " " and not _JOINED.search(text):
        return text.split(" ")
    return _CUT.split(text)


class Encoder:
    """Token ids of segments by both tokenizers, with the byte lengths of all ids; keeps the tokens of short segments."""

    def __init__(self, folder: str, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(f"{folder}/{byte_file}")
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{piece_file}")
        char = _byte_level()
        entries = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            self.a_bytes[i] = bytes(char[c] for c in entry) if all(c in char for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for i, p in enumerate(pieces) if not self.b.is_control(i)):
            raise ValueError(f"{piece_file} has pieces across words, which can't be encoded a segment at a time")
        self.spelt = [pa.array(x, pa.large_binary()) for x in (self.a_bytes, self.b_bytes)]
        self.lengths = [np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes)]
        self.a_len, self.b_len = (pa.array(x) for x in self.lengths)
        # the same merges by another library, which is faster: only where ids are in the order of the merges, words are cut by the usual rule, and classes of characters are beyond doubt
        spec = json.loads(self.a.to_str())
        vocabulary, merges = spec["model"]["vocab"], spec["model"]["merges"]
        usual = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("use_regex") and not spec["pre_tokenizer"]["add_prefix_space"] and not spec["model"].get("ignore_merges")
        ordered = all(vocabulary.get("".join(m if isinstance(m, list) else m.split(" "))) == 256 + i for i, m in enumerate(merges))
        ranks = {self.a_bytes[i]: i for i in range(256 + len(merges))}
        self.same = tiktoken.Encoding("same", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={}) if usual and ordered and len(ranks) == 256 + len(merges) else None
        self.clear()

    def _ids_of_a(self, text: str) -> np.ndarray:
        if self.same and not _RARE.search(text):
            return np.array(self.same.encode_ordinary(text), np.int32)
        return np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def clear(self) -> None:
        """Forget all segments."""
        self.at: dict[str, int] = {}
        self.ids = [[np.empty(0, np.int32)], [np.empty(0, np.int32)]]  # by tokenizer: ids of the segments in order, in pieces
        self.sizes = [[np.empty(0, np.int64)], [np.empty(0, np.int64)]]
        self.right = [np.empty(0, bool)]
        self.letters = 0

    def tokens(self, flat: list[str]) -> tuple[np.ndarray, np.ndarray, list[pa.ListArray]]:
        """(number of each segment, whether each number's tokens spell its bytes, the token lists of A and of B by number; empty where they don't)."""
        if len(self.at) > KEPT or self.letters > KEPT * SHORT:
            self.clear()
        of = np.fromiter(map(self.at.get, flat, repeat(-1)), np.int64, len(flat))
        unseen = np.flatnonzero(of < 0)
        if unseen.size:
            new = list(dict.fromkeys(flat[i] for i in unseen))
            # ends of several segments are told apart in their tokens only if none ends in white space
            plain = [s for s in new if s and not s[-1].isspace()]
            for lo in range(0, len(plain), TOGETHER):
                some = plain[lo : lo + TOGETHER]
                if not self._add(some):
                    for s in some:
                        self._add([s]) or self._wrong(s)
            for s in new:
                if not s or s[-1].isspace():
                    self._add([s]) or self._wrong(s)
            of[unseen] = np.fromiter(map(self.at.get, (flat[i] for i in unseen)), np.int64, unseen.size)
        lists = []
        for n in (0, 1):
            self.ids[n], self.sizes[n] = [np.concatenate(self.ids[n])], [np.concatenate(self.sizes[n])]
            lists.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(self.sizes[n][0])), pa.int32()), pa.array(self.ids[n][0])))
        self.right = [np.concatenate(self.right)]
        return of, self.right[0], lists

    def _add(self, some: list[str]) -> bool:
        """Encode segments in one string; False, and nothing is added, if the tokens don't spell it or don't end where a segment does."""
        text = " " + " ".join(some)
        spelt = [len(s.encode()) + 1 for s in some]
        ends = np.cumsum(spelt)
        of_b = self.b.encode(text[1:], num_threads=1) or [self.b.piece_to_id("▁")]  # a lone space, which it doesn't add to an empty text
        raw, found = text.encode(), []
        for n, ids in enumerate((self._ids_of_a(text), np.array(of_b, np.int32))):
            reached = np.cumsum(self.lengths[n][ids])
            if reached[-1] != len(raw) or self.spelt[n].take(pa.array(ids)).buffers()[2].to_pybytes()[: len(raw)] != raw:
                return False
            last = np.searchsorted(reached, ends)
            if not np.array_equal(reached[last], ends):
                return False
            found.append((ids, np.diff(last, prepend=-1)))
        for n, (ids, sizes) in enumerate(found):
            self.ids[n].append(ids)
            self.sizes[n].append(sizes)
        self._number(some, True)
        return True

    def _wrong(self, s: str) -> None:
        for n in (0, 1):
            self.sizes[n].append(np.zeros(1, np.int64))
        self._number([s], False)

    def _number(self, some: list[str], right: bool) -> None:
        self.right.append(np.full(len(some), right))
        self.letters += sum(map(len, some))
        self.at.update(zip(some, range(len(self.at), len(self.at) + len(some))))


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def aligned(encoder: Encoder, tokens: list[pa.ListArray], of: np.ndarray, doc: np.ndarray, docs: int) -> tuple[dict[str, np.ndarray], pa.Array, pa.Table]:
    """Of one slice: numbers of each document, its groups as text, and the table doc, pair, times.

    tokens: of A and of B by the number of a segment; `of` and `doc`: the number and the document of every segment in order.
    """
    doc_of = pa.array(doc, pa.int64())

    def side(n: int, lengths: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """(ids, document, end in the document) of all tokens of one tokenizer."""
        lists = tokens[n].take(pa.array(of))
        ids = pc.list_flatten(lists)
        at = doc_of.take(pc.list_parent_indices(lists))
        ends = pc.cumulative_sum(lengths.take(ids))
        last = np.zeros(docs + 1, np.int64)  # where each document ends in the slice
        np.maximum.at(last, np.asarray(at) + 1, np.asarray(ends))
        return ids, at, pc.subtract(ends, pa.array(np.maximum.accumulate(last)).take(at))

    (ids_a, doc_a, end_a), (ids_b, doc_b, end_b) = side(0, encoder.a_len), side(1, encoder.b_len)
    key = lambda at, end: pc.add(pc.shift_left(at, pa.scalar(40, pa.int64())), end)
    left = pa.table({"key": key(doc_a, end_a), "a": ids_a, "a_at": pa.array(np.arange(len(ids_a)))})
    right = pa.table({"key": key(doc_b, end_b), "b": ids_b, "b_at": pa.array(np.arange(len(ids_b)))})
    met = left.join(right, "key", join_type="full outer", use_threads=False).combine_chunks()
    met = met.take(pc.array_sort_indices(met["key"].combine_chunks()))
    at = pc.shift_right(met["key"], pa.scalar(40, pa.int64()))
    both = pc.and_(pc.is_valid(met["a"]), pc.is_valid(met["b"]))
    ends = met.filter(both)
    # lists of ids by group and of groups by document
    offsets = lambda x: pa.array(np.append(0, np.asarray(x) + 1), pa.int32())
    text = lambda ids, x: pc.binary_join(pa.ListArray.from_arrays(offsets(x), pc.cast(ids, pa.string())), ",")
    groups = pc.binary_join_element_wise(text(ids_a, ends["a_at"]), text(ids_b, ends["b_at"]), "|")
    count = lambda x: np.bincount(np.asarray(x), minlength=docs)
    number = {"n_a": count(doc_a), "n_b": count(doc_b), "n_links": count(at), "n_groups": count(at.filter(both))}
    by_doc = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number["n_groups"])), pa.int32()), groups)
    # a row of the join is an overlap of the next token of either side to end
    a, b = pc.fill_null_backward(met["a"]), pc.fill_null_backward(met["b"])
    pair = pc.add(pc.shift_left(pc.cast(a, pa.int64()), pa.scalar(32, pa.int64())), pc.cast(b, pa.int64()))
    links = pa.table({"doc": at, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    return number, pc.binary_join(by_doc, ";"), links.rename_columns(["doc", "pair", "times"]).sort_by("doc")


def _linked(folder: str, byte_file: str, piece_file: str, whole: bool):
    """Rows of _LINKED of each document; groups as text if `whole`, else their digest."""

    def told(groups: list[str]) -> str:
        if whole:
            return ";".join(groups)
        digest = hashlib.sha256()
        for n, g in enumerate(groups):
            digest.update((";" if n else "").encode() + g.encode())
        return digest.hexdigest()

    def run(batches):
        encoder = Encoder(folder, byte_file, piece_file)

        def rows(ids: list, parts: list[list[str]], at: list[int]) -> pa.RecordBatch:
            """Documents `ids`, of which the one at place k starts with part at[k]; a slice holds whole documents or a part of one."""
            number: dict[str, list[np.ndarray]] = {}
            said: list[list[str]] = [[] for _ in ids]
            tables, n_docs = [], len(ids)
            lo = 0
            while lo < len(parts):
                hi, size = lo, 0
                while hi < len(parts) and (hi == lo or size + len(parts[hi]) <= SLICE):
                    size += len(parts[hi])
                    hi += 1
                flat = [s for p in parts[lo:hi] for s in p]
                of, right, tokens = encoder.tokens(flat)
                doc = np.repeat(np.array(at[lo:hi], np.int64), [len(p) for p in parts[lo:hi]])
                if not right[of].all():
                    wrong.update(np.unique(doc[~right[of]]).tolist())
                    keep = ~np.isin(doc, list(wrong))
                    of, doc = of[keep], doc[keep]
                if of.size:
                    base = int(doc[0])
                    n, groups, links = aligned(encoder, tokens, of, doc - base, int(doc[-1]) - base + 1)
                    for name, x in n.items():
                        number.setdefault(name, [np.zeros(n_docs, np.int64)])[0][base : base + len(x)] += x
                    for k, g in enumerate(groups.to_pylist()):
                        if g:
                            said[base + k].append(g)
                    tables.append(links.set_column(0, "doc", pc.add(links["doc"], base)))
                lo = hi
            ok = np.array([k not in wrong for k in range(n_docs)])
            names = ["n_a", "n_b", "n_groups", "n_links"]
            columns = [pa.array(np.where(ok, number[n][0], 0) if n in number else np.zeros(n_docs, np.int64)) for n in names]
            texts = pa.array([told(g) if g and k not in wrong else "" for k, g in enumerate(said)], pa.string())
            if tables:
                links = pa.concat_tables(tables).filter(pa.array(ok).take(pa.concat_tables(tables)["doc"]))
                if len(set(at)) < len(at):  # documents in several parts: their pairs are added up
                    links = links.group_by(["doc", "pair"], use_threads=False).aggregate([("times", "sum")]).rename_columns(["doc", "pair", "times"]).sort_by("doc")
                links = links.combine_chunks()
                found = np.bincount(np.asarray(links["doc"]), minlength=n_docs)
                pairs, times = links["pair"].combine_chunks(), links["times"].combine_chunks()
            else:
                found, pairs, times = np.zeros(n_docs, np.int64), pa.array([], pa.int64()), pa.array([], pa.int64())
            offsets = pa.array(np.append(0, np.cumsum(found)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pairs), pa.ListArray.from_arrays(offsets, pc.cast(times, pa.int32()))]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns, texts, *lists], ["doc_id", *names, "groups", "pairs", "times"])

        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), b.column("text")
            held: list = []
            parts: list[list[str]] = []
            at: list[int] = []
            size = 0
            wrong: set[int] = set()
            for i in range(b.num_rows):
                text = texts[i].as_py()
                cuts = segments(text) if text else []
                for lo in range(0, len(cuts), SLICE):
                    parts.append(cuts[lo : lo + SLICE])
                    at.append(len(held))
                held.append(ids[i])
                size += len(cuts)
                if size >= SLICE:
                    yield rows(held, parts, at)
                    held, parts, at, size, wrong = [], [], [], 0, set()
            if held:
                yield rows(held, parts, at)

    return run


def _partial():
    """(pair, docs): documents of a task that hold each pair, in portions of at most PARTIAL distinct pairs and a batch."""

    def run(batches):
        held = None
        for b in batches:
            found = pa.table({"pair": pc.list_flatten(b.column("pairs"))}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "docs"])
            if held is not None:
                found = pa.concat_tables([held, found]).group_by("pair", use_threads=False).aggregate([("docs", "sum")]).rename_columns(["pair", "docs"])
            held = found
            if held.num_rows > PARTIAL:
                yield from held.combine_chunks().to_batches()
                held = None
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return run


def links(docs: DataFrame, folder: str = FOLDER, byte_file: str = BYTES, piece_file: str = PIECES, whole: bool = False) -> DataFrame:
    """A row for each row of `docs` (doc_id, text), written: doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times.

    `groups`: of each group the ids of A, "|", those of B, joined by ";" (all of it if `whole`, else the SHA-256 of that). `pairs`: the distinct linked id
    pairs, A's id * 2**32 + B's, with their numbers of links, `times`.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(_linked(folder, byte_file, piece_file, whole), _LINKED)
    return cut(found.withColumn("row", F.monotonically_increasing_id()), "aligned")


def pair_counts(linked: DataFrame) -> DataFrame:
    """pair, docs, best (written): documents that hold each linked pair, and whether no pair of its A id is held by more."""
    docs = cut(linked.select("pairs").mapInArrow(_partial(), "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")
    of_a = docs.withColumn("a", F.shiftright("pair", 32))
    highest = of_a.groupBy("a").agg(F.max("docs").alias("most"))
    return cut(of_a.join(highest, "a").select("pair", "docs", (F.col("docs") == F.col("most")).alias("best")), "counts")


def looked_up(linked: DataFrame, counts: DataFrame) -> DataFrame:
    """row, n_best, count_sum of each row of `linked` that has links."""
    step = F.floor(F.log2("docs")).cast("int")
    number, lowest = 0, 64
    for s, n in sorted(((r["s"], r["n"]) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("n")).collect()), reverse=True):
        if number + n > HELD:
            break
        number, lowest = number + n, s
    each = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("docs") * F.col("times")).alias("count_sum")]
    frequent = F.broadcast(counts.where(step >= lowest))
    out = each.join(frequent, "pair").groupBy("row").agg(*sums)
    rare = counts.where(step < lowest)
    if rare.take(1):  # each of these pairs is held by fewer than 2 ** lowest documents
        few = each.join(F.broadcast(counts.where(step >= lowest).select("pair")), "pair", "left_anti").join(rare.hint("merge"), "pair").groupBy("row").agg(*sums)
        out = out.union(few).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out


def align(docs: DataFrame, folder: str = FOLDER, byte_file: str = BYTES, piece_file: str = PIECES, whole: bool = False) -> DataFrame:
    """A row for each row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (as of `links`).

    n_best: links whose pair is held by as many documents as any pair of that A id; count_sum: over links, documents that hold the pair.
    """
    linked = links(docs, folder, byte_file, piece_file, whole)
    found = looked_up(linked, pair_counts(linked))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return linked.drop("pairs", "times").join(found, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups")
