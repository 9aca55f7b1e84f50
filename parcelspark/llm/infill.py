"""Fill-in-the-middle examples by a parallel scan of a finite automaton.

The automaton reads UTF-8 bytes. Its states say whether a line begins here or goes on, how much of one of the three signs has just been read, and whether a sign has been found. Texts are cut into chunks of at most ``CHUNK`` bytes. A chunk is read without what stands before it: it gives, for each state in which it could be entered, the state in which it is left and the lines that begin in it. Such functions compose associatively: in a chunk pairwise, in a tree; between chunks by groups of ``GROUP``, whose functions are composed once more for each text, so that every chunk learns the state in which it is entered and the lines before it. A text's lines and signs follow, with them the form and the two cuts, and each chunk selects those cuts that fall into it.

A text of one chunk stays in its batch: there is nothing to deal out. Chunks of longer texts are dealt out: they lie in small row groups of a table in the shared folder, so that tasks share the chunks of one text, and meet their text's cuts by a join; outputs are put together by sorting parts, and digested as a stream, a part at a time. No task holds more of such a text than a few chunks. Only sha256 itself is sequential: one task reads the parts of one output.

Defined results: a null text is taken for an empty one; an empty text is plain, with no lines; a null id is hashed as ``null``; rows that repeat are each returned; an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelspark.llm.common import materialise, tidy, whole_groups

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Sections of a text, and the order in which each form has them.
SECTIONS = (PREFIX, MIDDLE, SUFFIX)
FORMS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Bytes of a chunk, and chunks whose functions are composed in one step.
CHUNK, GROUP = 1 << 15, 256
#: Bytes of short texts that are worked on at once, and of a row group of chunks.
AT_ONCE, ROW_GROUP = 1 << 22, 1 << 20

START, LINE, OPENED, LETTER, START_FOUND, LINE_FOUND = range(6)
OTHER, NEWLINE, LESS, NAME, GREATER = range(5)
CLASS = np.zeros(256, dtype=np.uint8)
for _class, _bytes in ((NEWLINE, b"\n"), (LESS, b"<"), (NAME, b"PSM"), (GREATER, b">")):
    CLASS[list(_bytes)] = _class
#: The state after a byte of a class, for each state before it; whether a line begins with a byte read in a state.
NEXT = np.array(
    [
        [LINE, LINE, LINE, LINE, LINE_FOUND, LINE_FOUND],
        [START, START, START, START, START_FOUND, START_FOUND],
        [OPENED, OPENED, OPENED, OPENED, LINE_FOUND, LINE_FOUND],
        [LINE, LINE, LETTER, LINE, LINE_FOUND, LINE_FOUND],
        [LINE, LINE, LINE, LINE_FOUND, LINE_FOUND, LINE_FOUND],
    ],
    dtype=np.uint8,
)
BEGINS = np.array([1, 0, 0, 0, 1, 0], dtype=np.int64)


def composed(step: np.ndarray, count: np.ndarray, owner: np.ndarray, owners: int) -> tuple[np.ndarray, np.ndarray]:
    """The functions (state after, lines begun; a row of six for each state before) of each owner, one after the other, as one. Rows are in the order of owners; an owner without any gets the identity."""
    while len(owner) > len(np.unique(owner)):
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        left = np.flatnonzero(rank % 2 == 0)
        right = np.minimum(left + 1, len(owner) - 1)
        alone = (left + 1 >= len(owner)) | (owner[right] != owner[left])
        through = step[left]
        step_after = np.take_along_axis(step[right], through.astype(np.int64), 1)
        count_after = count[left] + np.take_along_axis(count[right], through.astype(np.int64), 1)
        step, count, owner = np.where(alone[:, None], through, step_after), np.where(alone[:, None], count[left], count_after), owner[left]
    steps, counts = np.tile(np.arange(6, dtype=np.uint8), (owners, 1)), np.zeros((owners, 6), dtype=np.int64)
    steps[owner], counts[owner] = step, count
    return steps, counts


def functions(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The functions of the chunks between the cuts of data."""
    kind = CLASS[data]
    first = np.zeros(len(data), dtype=bool)
    first[cuts[:-1][cuts[:-1] < cuts[1:]]] = True
    # A letter or an end that does not go on with a sign is like any other byte, and any other byte after another changes nothing.
    for sign, after in ((NAME, LESS), (GREATER, NAME)):
        at = np.flatnonzero(kind == sign)
        kind[at[~first[at] & (kind[at - 1] != after)]] = OTHER
    same = np.zeros(len(data), dtype=bool)
    same[1:] = (kind[1:] == OTHER) & (kind[:-1] == OTHER) & ~first[1:]
    at = np.flatnonzero(~same)
    owner = np.searchsorted(cuts, at, side="right") - 1
    return composed(NEXT[kind[at]], np.tile(BEGINS, (len(at), 1)), owner, len(cuts) - 1)


def _form(n: Column, found: Column, h3: Column, h4: Column, rate: int, spm: int) -> Column:
    return F.when((n == 0) | found | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of texts without nulls."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = texts.buffers()[2]
    return offsets, np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)


WHOLE = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _whole(rate: int, spm: int):
    """From (doc_id, text, h1 to h4) of short texts to WHOLE."""

    def some(batch: pa.RecordBatch, offsets: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
        data, cuts = whole[offsets[0] : offsets[-1]], offsets - offsets[0]
        steps, counts = functions(data, cuts)
        n, found = counts[:, START], steps[:, START] >= START_FOUND
        h = [batch[f"h{k}"].to_numpy() for k in range(1, 5)]
        plain = (n == 0) | found | (h[2] % 100 >= rate)
        form = np.where(plain, "plain", np.where(h[3] % 100 < spm, "spm", "psm"))
        line = np.flatnonzero(data == 10)
        before = np.searchsorted(line, cuts[:-1])
        lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]

        def place(units: np.ndarray) -> np.ndarray:
            at = line[np.minimum(before + units - 1, max(len(line) - 1, 0))] + 1 if len(line) else cuts[1:]
            return np.where(units == 0, cuts[:-1], np.where(units == n, cuts[1:], at))

        a, b = (place(f(h[0] % (n + 1), h[1] % (n + 1))) for f in (np.minimum, np.maximum))
        out = []
        for f, lo, x, y, hi in zip(form.tolist(), cuts[:-1].tolist(), a.tolist(), b.tolist(), cuts[1:].tolist(), strict=True):
            section = {PREFIX: (lo, x), MIDDLE: (x, y), SUFFIX: (y, hi)}
            out.append(data[lo:hi].tobytes() if f == "plain" else b"".join(s.encode() + data[slice(*section[s])].tobytes() for s in FORMS[f]))
        chars = [pa.array(lead[y] - lead[x], pa.int64(), mask=plain) for x, y in ((cuts[:-1], a), (a, b))]
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *chars, pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, whole = _bytes_of(batch["text"])
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + AT_ONCE, side="right")) - 1)
                yield some(batch.slice(first, last - first), offsets[first : last + 1], whole)
                first = last

    return run


CHUNKS = "key binary, doc_id long, h1 long, h2 long, h3 long, h4 long, k long, chunk string"


def _cut(chunk: int):
    """Texts in chunks, cut between code points. Each row gets a key of its own, which holds since the chunks are written before they are used."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, whole = _bytes_of(batch["text"])
            for i in range(batch.num_rows):
                data, key, cuts = whole[offsets[i] : offsets[i + 1]], uuid.uuid4().bytes, [0]
                while cuts[-1] < len(data):
                    to = min(cuts[-1] + chunk, len(data))
                    while to < len(data) and data[to] & 0xC0 == 0x80:
                        to -= 1
                    cuts.append(to)
                for at in range(0, len(cuts) - 1, 64):
                    some = list(zip(cuts[at : at + 64], cuts[at + 1 : at + 65], strict=False))
                    same = [pa.array([key] * len(some), pa.binary()), *(pa.array([batch[c][i].as_py()] * len(some), pa.int64()) for c in ("doc_id", "h1", "h2", "h3", "h4"))]
                    yield pa.RecordBatch.from_arrays([*same, pa.array(range(at, at + len(some)), pa.int64()), pa.array([data[x:y].tobytes() for x, y in some], pa.binary()).cast(pa.string())], names=["key", "doc_id", "h1", "h2", "h3", "h4", "k", "chunk"])

    return run


FUNCTIONS = "key binary, k long, step binary, count array<long>"


def _function_rows(key: pa.Array, k: pa.Array, steps: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 6 * len(steps) + 1, 6), pa.int32()), pa.array(counts.ravel()))
    return pa.RecordBatch.from_arrays([key, k, pa.array([s.tobytes() for s in steps], pa.binary()), lists], names=["key", "k", "step", "count"])


def _functions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            offsets, whole = _bytes_of(some["chunk"])
            yield _function_rows(some["key"], some["k"], *functions(whole[offsets[0] : offsets[-1]], offsets - offsets[0]))


def _arrays(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(b"".join(t["step"].to_pylist()), dtype=np.uint8).reshape(-1, 6)
    return steps, np.array(t["count"].combine_chunks().flatten()).reshape(-1, 6)


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From functions of chunks, sorted by (key, grp, k), to those of groups; k: the group's number."""
    for t in whole_groups(batches, ["key", "grp"]):
        grp, key = t["grp"].to_numpy(), t["key"].combine_chunks()
        same = np.array(key.dictionary_encode().indices)
        new = np.r_[True, (grp[1:] != grp[:-1]) | (same[1:] != same[:-1])]
        first = np.flatnonzero(new)
        yield _function_rows(key.take(pa.array(first)), pa.array(grp[first]), *composed(*_arrays(t), np.cumsum(new) - 1, len(first)))


ENTRIES = "key binary, k long, state int, before long, after int, total long"


def _entered(within: list[str]):
    """Walks through the functions of whole groups in their order, from a group's own state and lines before it: for each row those before it, and those after it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, within):
            steps, counts = _arrays(t)
            last, state, before, out = None, 0, 0, []
            for row, step, count in zip(zip(*(t[c].to_pylist() for c in (*within, "from_state", "from_lines")), strict=True), steps.tolist(), counts.tolist(), strict=True):
                if row != last:
                    last, (state, before) = row, row[-2:]
                out.append((state, before, step[state], before + count[state]))
                state, before = out[-1][2:]
            state, before, after, total = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([t["key"].combine_chunks(), t["k"].combine_chunks(), pa.array(state, pa.int32()), pa.array(before, pa.int64()), pa.array(after, pa.int32()), pa.array(total, pa.int64())], names=["key", "k", "state", "before", "after", "total"])

    return run


def _split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with what is known of them to their pieces of each section; a chunk of a plain text is one piece."""
    for batch in batches:
        rows = []
        for r in batch.select(["key", "k", "chunk", "state", "before", "form", "a", "b"]).to_pylist():
            data = r["chunk"].encode()
            begins = np.flatnonzero(np.frombuffer(data, np.uint8)[:-1] == 10) + 1
            if BEGINS[r["state"]]:
                begins = np.r_[0, begins]
            cut = [0 if u < r["before"] else len(data) if u - r["before"] >= len(begins) else int(begins[u - r["before"]]) for u in (r["a"], r["b"])]
            bounds = [0, len(data)] if r["form"] == "plain" else [0, *cut, len(data)]
            rows += [(r["key"], s, r["k"], data[x:y].decode()) for s, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if x < y]
        columns = zip(*rows, strict=True) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, (pa.binary(), pa.int32(), pa.int64(), pa.string()), strict=True)], names=["key", "section", "k", "piece"])


def _by_sections(of, form: Column, default: Column) -> Column:
    """The value that ``of`` gives for each form."""
    out = default
    for name in FORMS:
        out = F.when(form == name, of(name)).otherwise(out)
    return out


def _met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.hint("merge").join(right.hint("merge"), on)


@tidy
def _long_parts(docs: DataFrame, rate: int, spm: int) -> DataFrame:
    width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = materialise(docs.mapInArrow(_cut(CHUNK), CHUNKS), **{"parquet.block.size": ROW_GROUP})
    each = materialise(chunks.select("key", "k", "chunk").mapInArrow(_functions, FUNCTIONS)).withColumn("grp", F.col("k").bitwiseAND(-GROUP))
    groups = each.repartition(width, "key", "grp").sortWithinPartitions("key", "grp", "k").mapInArrow(_grouped, FUNCTIONS)
    # The groups of one text: 2 GiB at most, so 256 groups.
    groups = groups.repartition(width, "key").sortWithinPartitions("key", "k").withColumn("from_state", F.lit(START)).withColumn("from_lines", F.lit(0).cast("long"))
    groups = materialise(groups.mapInArrow(_entered(["key"]), ENTRIES))
    entered = _met(each, groups.select("key", F.col("k").alias("grp"), F.col("state").alias("from_state"), F.col("before").alias("from_lines")), ["key", "grp"])
    entered = entered.repartition(width, "key", "grp").sortWithinPartitions("key", "grp", "k").mapInArrow(_entered(["key", "grp"]), ENTRIES)
    texts = groups.groupBy("key").agg(F.max("total").alias("n"), F.max(F.col("after") >= START_FOUND).alias("found"))
    texts = _met(texts, chunks.filter("k = 0").select("key", "doc_id", "h1", "h2", "h3", "h4"), ["key"])
    units = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    texts = materialise(texts.select("key", "doc_id", "n", _form(F.col("n"), F.col("found"), F.col("h3"), F.col("h4"), rate, spm).alias("form"), F.least(*units).alias("a"), F.greatest(*units).alias("b")))

    known = _met(entered.select("key", "k", "state", "before"), texts.select("key", "form", "a", "b"), ["key"])
    pieces = materialise(_met(chunks.select("key", "k", "chunk"), known, ["key", "k"]).mapInArrow(_split, "key binary, section int, k long, piece string"))
    chars = pieces.groupBy("key").agg(*[F.coalesce(F.sum(F.when(F.col("section") == s, F.char_length("piece"))), F.lit(0)).cast("long").alias(c) for s, c in enumerate(("prefix_chars", "middle_chars"))])
    texts = _met(texts, chars, ["key"]).select("key", "doc_id", "n", "form", *[F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")])
    signs = texts.select("key", F.explode(_by_sections(lambda f: F.array(*[F.struct(F.lit(SECTIONS.index(s)).alias("section"), F.lit(-1).cast("long").alias("k"), F.lit(s).alias("piece")) for s in FORMS[f]]), F.col("form"), F.lit(None))).alias("sign")).select("key", "sign.*")
    parts = _met(pieces.unionByName(signs), texts, ["key"])
    slot = _by_sections(lambda f: F.array_position(F.array(*[F.lit(SECTIONS.index(s)) for s in FORMS[f]]), F.col("section")), F.col("form"), F.lit(0))
    # Parts of an output are in the order of these numbers; signs stand before the pieces of their section.
    return parts.select("key", "doc_id", "n", "form", "prefix_chars", "middle_chars", (F.shiftleft(slot.cast("long"), 40) + F.col("k") + 1).alias("part"), F.col("piece").alias("output"))


def infilled(docs: DataFrame, seed: str = "7", rate: int = 100, spm: int = 50) -> DataFrame:
    """Outputs: key, doc_id, n, form, prefix_chars, middle_chars, part, output. key is null for an output in one row; a longer text's output comes in several rows of one key, in the order of part.

    h1 to h4 are the first four 8-digit groups of the sha256 of ``seed:doc_id``: h1 and h2 choose the cuts among the n + 1 places between lines, h3 whether there are any (``rate`` in a hundred), h4 the form (``spm`` in a hundred)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short, long_ = (docs.filter(c).select("doc_id", "text", *h) for c in (F.octet_length("text") <= CHUNK, F.octet_length("text") > CHUNK))
    whole = short.mapInArrow(_whole(rate, spm), WHOLE).withColumn("key", F.lit(None).cast("binary")).withColumn("part", F.lit(0).cast("long"))
    return whole.unionByName(_long_parts(long_, rate, spm))


def restored(output: Column, form: Column) -> Column:
    """The text of an output in one row: each sign stands in it once."""
    between = {}
    for name, (_, second, third) in FORMS.items():
        body = F.substring(output, 4, 1 << 30)
        rest = F.substring_index(body, second, -1)
        section = dict(zip(FORMS[name], (F.substring_index(body, second, 1), F.substring_index(rest, third, 1), F.substring_index(rest, third, -1)), strict=True))
        between[name] = F.concat(*[section[s] for s in SECTIONS])
    return _by_sections(between.get, form, output)


DIGESTED = "key binary, section int, part long, piece string, sha256 string"


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(zip(*rows, strict=True), (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["key", "section", "part", "piece", "sha256"])


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads outputs as streams of parts in their order: the digest of each, and the pieces of text between its signs. Two characters are held back while a sign may go on in the next part."""
    key, digest, held, signs, section, number = None, hashlib.sha256(), "", [], 0, 0

    def ended() -> Iterator[pa.RecordBatch]:
        if key is not None:
            yield _digest_rows([(key, section, number, held, None), (key, None, None, None, digest.hexdigest())])

    for batch in batches:
        for k, form, output in zip(batch["key"].to_pylist(), batch["form"].to_pylist(), batch["output"].to_pylist(), strict=True):
            if k != key:
                yield from ended()
                key, digest, held, signs, section, number = k, hashlib.sha256(), "", list(FORMS.get(form, ())), 0, 0
            digest.update(output.encode())
            held += output
            while signs and (at := held.find(signs[0])) >= 0:
                yield _digest_rows([(key, section, number, held[:at], None)])
                held, section, number = held[at + len(signs[0]) :], SECTIONS.index(signs.pop(0)), number + 1
            ready = held[:-2] if signs else held
            yield _digest_rows([(key, section, number, ready, None)])
            held, number = held[len(ready) :], number + 1
    yield from ended()


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, digest = None, hashlib.sha256()
    for batch in batches:
        for k, piece in zip(batch["key"].to_pylist(), batch["piece"].to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    yield _digest_rows([(key, None, None, None, digest.hexdigest())])
                key, digest = k, hashlib.sha256()
            digest.update(piece.encode())
    if key is not None:
        yield _digest_rows([(key, None, None, None, digest.hexdigest())])


def digests(outputs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars of each output, with output_sha256 and the restored_sha256 of the text that is rebuilt from output and form alone."""
    width = max(1, int(outputs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    about = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    short = outputs.filter("key is null").select(*about, F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    parts = outputs.filter("key is not null")
    parsed = materialise(parts.select("key", "form", "part", "output").repartition(width, "key").sortWithinPartitions("key", "part").mapInArrow(_parsed, DIGESTED))
    rebuilt = parsed.filter("sha256 is null").repartition(width, "key").sortWithinPartitions("key", "section", "part").mapInArrow(_hashed, DIGESTED)
    sums = [d.filter("sha256 is not null").select("key", F.col("sha256").alias(c)) for d, c in ((parsed, "output_sha256"), (rebuilt, "restored_sha256"))]
    texts = _met(parts.select("key", *about).dropDuplicates(["key"]), sums[0], ["key"])
    return short.unionByName(_met(texts, sums[1], ["key"]).drop("key"))
