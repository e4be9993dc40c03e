"""Token ids in files: frequency-ranked, byte-aligned variable-length codes with separate control bytes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from quern.llm.bpe import Remembered, gather, own_texts, slices
from quern.llm.common import bucket_of, give_back, materialize, new_dir, range_bounds

END = 1
#: Ids are below this.
IDS = 65_536
#: Bytes of text whose distinct words are looked up together, and stems whose ids a task remembers (about 50 bytes each).
TEXT_BYTES = 4_000_000
REMEMBERED = 300_000
#: Words that go to the tokenizer in one string, and what stands between them.
TOGETHER = 200
BAR = "|"
#: ASCII marks but the apostrophe, which can begin a token with letters.
MARKS = r"[!-&(-/:-@\[-`{-~]"
#: Tokens in a block of the files, and documents in a file (more if there are more than MOST_FILES times as many).
BLOCK_TOKENS = 500_000
ROWS_PER_FILE = 8192
MOST_FILES = 65_536

#: For each control byte (four 2-bit lengths less one, the first in the low bits): the bytes its four codes take.
_LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data): a code takes as many bytes as its number needs, low byte first; two bits tell how many."""
    n = len(ranks)
    padded = np.zeros(-(-n // 4) * 4, dtype="<u4")
    padded[:n] = ranks
    size = 1 + (padded > 0xFF) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    control = ((size.reshape(-1, 4) - 1) << np.array([0, 2, 4, 6])).sum(axis=1).astype(np.uint8)
    used = np.arange(4) < size[:, None]
    used[n:] = False
    return control.tobytes(), padded.view(np.uint8).reshape(-1, 4)[used].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of :func:`pack`; lengths come from a table over control bytes."""
    size = _LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    start = np.cumsum(size) - size
    raw = np.frombuffer(data, dtype=np.uint8)
    out = raw[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if not len(longer):
            break
        out[longer] |= raw[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def word_ends(tokenizer: Tokenizer) -> np.ndarray:
    """For each id whether it ends a piece of text, as its suffix says; all False if the vocabulary has no such suffix."""
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size() + 1, bool)
    ends[[i for t, i in tokenizer.get_vocab().items() if suffix and t.endswith(suffix)]] = True
    return ends


def _encode_words(tokenizer: Tokenizer, words: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words, one after the other, and where each one's begin.

    Words go to the tokenizer by the hundred. Those of letters alone are one piece each, whose last id tells its end
    (if there are more pieces than words, a letter's small form was no letter, and they go the other way). Others have a bar between them, whose id marks their ends,
    and those that hold a bar go alone.
    """
    bar = tokenizer.encode(BAR, add_special_tokens=False).ids
    found, at, sizes = [], [], np.zeros(len(words), np.int64)
    whole = lambda texts: [np.array(x.ids, dtype=np.int32) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    letters = pc.match_substring_regex(words, r"^\p{L}+$").to_numpy(zero_copy_only=False) & ends.any()
    alone = pc.match_substring(words, BAR).to_numpy(zero_copy_only=False)
    joined = [np.flatnonzero(~letters & ~alone)]
    plain = np.flatnonzero(letters)
    for i in range(0, len(plain), TOGETHER * 100):
        here = plain[i : i + TOGETHER * 100]
        some = words.take(pa.array(here)).to_pylist()
        for k, ids in zip(range(0, len(some), TOGETHER), whole([" ".join(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]), strict=True):
            last, mine = np.flatnonzero(ends[ids]), here[k : k + TOGETHER]
            if len(last) != len(mine):
                joined.append(mine)
                continue
            sizes[mine] = np.diff(last, prepend=-1)
            found.append(ids)
            at.append(mine)
    joined = np.concatenate(joined)
    for i in range(0, len(joined), TOGETHER * 100):
        here = joined[i : i + TOGETHER * 100]
        some = words.take(pa.array(here)).to_pylist()
        ids = np.concatenate(whole([f" {BAR} ".join(some[k : k + TOGETHER]) + f" {BAR}" for k in range(0, len(some), TOGETHER)]))
        last = np.flatnonzero(ids == bar[0])
        sizes[here] = np.diff(last, prepend=-1) - 1
        found.append(np.delete(ids, last))
        at.append(here)
    for i in np.flatnonzero(alone).tolist():
        found.append(np.array(tokenizer.encode(words[i].as_py(), add_special_tokens=False).ids, dtype=np.int32))
        sizes[i] = len(found[-1])
        at.append(np.array([i]))
    starts = np.append(0, np.cumsum(sizes))
    if not found:
        return np.empty(0, np.int32), starts
    order = np.concatenate(at)
    back = np.empty(len(words), np.int64)
    back[order] = np.arange(len(order))
    return gather(np.append(0, np.cumsum(sizes[order])), np.concatenate(found), back), starts


def stem_encoder(tokenizer: Tokenizer) -> Remembered:
    ends = word_ends(tokenizer)
    return Remembered(lambda words: _encode_words(tokenizer, words, ends), REMEMBERED)


def _encode_distinct(stems: Remembered, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of different words, one after the other, and where each one's begin.

    Words may share a stem: marks after a word's last small letter are always tokens of their own.
    """
    cut = pc.extract_regex(words, rf"(?s)^(?P<stem>.*\p{{Ll}})(?P<marks>{MARKS}+)$")
    stem = pc.coalesce(pc.struct_field(cut, "stem"), words)
    marks = pc.coalesce(pc.struct_field(cut, "marks"), pa.scalar("", words.type))
    both = pa.concat_arrays([stem, marks]).dictionary_encode()
    place = stems.places(both.dictionary)[both.indices.to_numpy()].reshape(2, -1)
    sizes = (stems.starts[1:] - stems.starts[:-1])[place].sum(axis=0)
    return gather(stems.starts, stems.ids, place.T.ravel()), np.append(0, np.cumsum(sizes))


def encode_texts(tokenizer: Tokenizer, texts: pa.Array, stems: Remembered | None = None) -> Iterator[np.ndarray]:
    """Ids of each text (null: none), the end id last.

    This vocabulary lowers case, drops white space and never joins what it separates, so a text's ids are those
    of its words, and each distinct word is encoded once. Texts with an added token's content go to the library
    whole, which recognises it unless the tokenizer encodes special tokens like other text. ``stems`` is what
    earlier calls with this tokenizer have met.
    """
    texts, as_text = own_texts(texts), tokenizer.encode_special_tokens
    stems = stems or stem_encoder(tokenizer)
    marked = {}
    if not as_text:
        hit = np.zeros(len(texts), bool)
        for token in tokenizer.get_added_tokens_decoder().values():
            hit |= pc.fill_null(pc.match_substring(texts, token.content, ignore_case=token.normalized), False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(hit).tolist():
            marked[i] = np.array(tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.int32)
        if marked:
            texts = pc.if_else(pa.array(hit), pa.scalar("", texts.type), texts)
    texts = pc.ascii_lower(texts)
    split = pc.ascii_split_whitespace(texts)
    offsets = split.offsets.to_numpy()
    coded = split.values.dictionary_encode()
    tokenizer.encode_special_tokens = True  # lower-cased or cut, a word can look like an added token
    try:
        ids, starts = _encode_distinct(stems, coded.dictionary)
    finally:
        tokenizer.encode_special_tokens = as_text
    unit = coded.indices.to_numpy()
    del split, coded, texts
    for i in range(len(offsets) - 1):
        yield np.append(marked[i] if i in marked else gather(starts, ids, unit[offsets[i] : offsets[i + 1]]), np.int32(END))


def tokenize(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row of docs; ids are little-endian unsigned 16-bit integers in a binary."""
    with open(path or public_tokenizers.path("word_bpe_49k.json")) as f:
        text = f.read()
    if max(Tokenizer.from_str(text).get_vocab().values()) >= IDS:
        raise ValueError(f"ids are kept in 16 bits; the vocabulary has {IDS} or more")
    content = docs.sparkSession.sparkContext.broadcast(text)  # below 2 MB, whatever the corpus
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already run side by side
        tokenizer = Tokenizer.from_str(content.value)
        stems = stem_encoder(tokenizer)
        for batch in batches:
            for part in slices(batch, "text", TEXT_BYTES):
                ids = [x.astype("<u2").tobytes() for x in encode_texts(tokenizer, part.column("text"), stems)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=schema)
                del ids
            give_back()
        del stems
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, n_tokens long, ids binary")


def id_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs, counted over all documents; an entry for each id of the vocabulary (below IDS)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(IDS, np.int64)
        for batch in batches:
            for i in range(0, len(batch), 512):
                ids = b"".join(batch.column("ids").slice(i, 512).to_pylist())
                total += np.bincount(np.frombuffer(ids, dtype="<u2"), minlength=IDS)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], names=["id", "n"])

    counted = tokens.select("ids").mapInArrow(of, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(IDS, np.int64)
    counts[counted["id"]] = counted["n"]
    return counts


def write_files(tokens: DataFrame, path: str, counts: np.ndarray, base: list[int], bounds: list[int]) -> None:
    """Writes tokens to path, ascending by doc_id within a file and from file to file, in blocks.

    A file holds one of the ranges of doc_ids that end at bounds; files are numbered like ranges, and base has the
    tokens before each. A block holds whole documents: their ids, their token counts, the control bytes and the
    data of all their tokens, and the number of tokens before it. The most frequent id has code 0. Files can be
    written and read side by side. Null ids come first; rows that share a doc_id follow each other by their ids.
    """
    rank_of = np.empty(len(counts), np.uint16)
    rank_of[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    spark = tokens.sparkSession
    sent = spark.sparkContext.broadcast((rank_of, base))

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranks, before = sent.value
        held, size, bucket, number, start = [], 0, None, 0, 0

        def block() -> pd.DataFrame:
            control, data = pack(ranks[np.concatenate([np.frombuffer(x, dtype="<u2") for _, x in held])])
            names = pd.DataFrame({"bucket": [bucket], "block": [number], "start": [start]})
            names["doc_ids"] = [np.array([-1 if d is None else d for d, _ in held], "<i8").tobytes()]
            names["no_id"] = [bytes(d is None for d, _ in held)]
            names["sizes"] = [np.array([len(x) // 2 for _, x in held], "<i8").tobytes()]
            return names.assign(control=[control], data=[data])

        for rows in batches:
            for b, d, x in zip(rows["bucket"], rows["doc_id"], rows["ids"], strict=True):
                if held and (b != bucket or size >= BLOCK_TOKENS):
                    yield block()
                    number, start, held, size = number + 1, start + size, [], 0
                if b != bucket:
                    bucket, number, start = b, 0, before[b]
                held.append((None if pd.isna(d) else int(d), x))
                size += len(x) // 2
        if held:
            yield block()

    dealt = tokens.select(bucket_of(F.col("doc_id"), bounds).cast("int").alias("bucket"), "doc_id", "ids")
    dealt = dealt.repartitionById(max(1, len(bounds)), "bucket").sortWithinPartitions("bucket", "doc_id", "ids")
    schema = "bucket int, block int, start long, doc_ids binary, no_id binary, sizes binary, control binary, data binary"
    dealt.mapInPandas(blocks, schema).write.option("compression", "none").parquet(path)
    id_of = pd.DataFrame({"rank": rank_of.astype(int), "id": np.arange(len(rank_of))}).sort_values("rank")
    spark.createDataFrame(id_of).coalesce(1).write.parquet(f"{path}-ids")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start counts the ids of all documents before; ids are 32 bits wide."""
    id_of = spark.read.parquet(f"{path}-ids").toPandas().sort_values("rank")["id"].to_numpy()  # an entry for each id of the vocabulary
    sent = spark.sparkContext.broadcast(id_of.astype("<u4"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for i in range(len(batch)) for r in batch.slice(i, 1).to_pylist()):
            sizes = np.frombuffer(row["sizes"], "<i8")
            ids = sent.value[unpack(row["control"], row["data"], int(sizes.sum()))]
            ends = np.cumsum(sizes)
            each = [ids[e - s : e].tobytes() for s, e in zip(sizes, ends, strict=True)]
            names = pa.array(np.frombuffer(row["doc_ids"], "<i8"), pa.int64(), mask=np.frombuffer(row["no_id"], bool))
            yield pa.RecordBatch.from_arrays(
                [names, pa.array(row["start"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(each, pa.binary())],
                names=["doc_id", "start", "n_tokens", "ids"],
            )

    blocks = spark.read.parquet(path).select("start", "doc_ids", "no_id", "sizes", "control", "data")
    return blocks.mapInArrow(of, "doc_id long, start long, n_tokens long, ids binary")


def store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None) -> str:
    """Encodes docs and writes the files under path and its ids' order under path-ids; returns path.

    Without a path they go to the shared folder, until the JVM ends. Every row is written, null and empty texts
    with the end id alone. Extra columns are left out. Ids are kept between the two passes (counting, then
    writing); a total for each file comes to the driver.
    """
    if path is None:
        path = f"{new_dir(docs.sparkSession, 'tokens-')}/files"
    tokens = materialize(tokenize(docs, vocabulary))
    bounds = range_bounds(tokens, "doc_id", ROWS_PER_FILE, MOST_FILES)
    bucket = bucket_of(F.col("doc_id"), bounds).cast("int")
    totals = {r["bucket"]: r["n"] for r in tokens.groupBy(bucket.alias("bucket")).agg(F.sum("n_tokens").alias("n")).collect()}
    base, before = [], 0
    for b in range(max(1, len(bounds))):
        base.append(before)
        before += totals.get(b, 0)
    write_files(tokens, path, id_counts(tokens), base, bounds)
    return path
