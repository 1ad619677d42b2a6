"""SentencePiece-style encoding by shared-prefix Viterbi, and exact decoding.

The text is cut before every space and around every other ASCII white-space character; a
leading space is the word's mark (U+2581 in the model file). Distinct marked words of a
block are sorted and walked depth-first: consecutive words share a prefix, and the
forward scores (best score of a segmentation of each prefix) of the shared part are
reused, so the walk is that of the words' trie. The best segmentation maximises the sum
of the vocabulary's piece scores; characters without a piece (a literal U+2581 too) are
written as byte pieces, so decoding gives back the text exactly.

The vocabulary is read from a public SentencePiece model file whose path is a parameter;
its scores are used as they are (the file's own merge order plays no part, so ids can
differ from that library's). Of equal scores the segmentation whose last piece is the
longest wins.

Defined results: null and empty texts have no pieces (sha256 of no bytes, round trip
true). A word costs its length times the number of piece lengths; repeated rows encode alike.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import chunks, tidy

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK_BYTES = 2_000_000      # texts handled together in a task, and rows sent back at once
MEMO_WORDS = 200_000         # words whose ids a task keeps between blocks
BYTE_SCORE = -1.0e6          # a byte piece only where no listed piece covers a character
CUT = re.compile(r"[\t\n\v\f\r]| ?[^ \t\n\v\f\r]+| ")


@dataclass(frozen=True)
class Vocabulary:
    scores: dict[str, tuple[float, int]]     # piece (mark as a space) -> score, id
    pieces: list[bytes]                      # id -> UTF-8 text it stands for
    byte_ids: list[int]                      # byte -> id of its byte piece
    lengths: dict[str, tuple[int, ...]]      # last three characters -> lengths of pieces that end so, longest first


_LOADED: dict[str, Vocabulary] = {}


def load_vocabulary(path: str = MODEL_FILE) -> Vocabulary:
    """Read once per Python process (the file is part of every machine's image)."""
    if path not in _LOADED:
        import sentencepiece
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        scores, pieces, byte_ids = {}, [], [0] * 256
        for i in range(p.get_piece_size()):
            x = p.id_to_piece(i)
            if p.is_byte(i):
                b = int(x[3:5], 16)
                byte_ids[b] = i
                pieces.append(bytes([b]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                pieces.append(b"")
            else:
                x = x.replace("▁", " ")
                scores[x] = (p.get_score(i), i)
                pieces.append(x.encode())
        ends: dict[str, set[int]] = {}
        for x in scores:
            if len(x) >= 3:
                ends.setdefault(x[-3:], set()).add(len(x))
        _LOADED[path] = Vocabulary(scores, pieces, byte_ids, {x: tuple(sorted(n, reverse=True)) for x, n in ends.items()})
    return _LOADED[path]


def encode_words(words: list[str], v: Vocabulary) -> dict[str, bytes]:
    """Distinct marked words -> their ids as int32 bytes, scoring shared prefixes once."""
    out: dict[str, bytes] = {}
    get, lengths = v.scores.get, v.lengths.get
    best: list[float] = [0.0]                    # per prefix length: best score,
    back: list[tuple] = [(0, ())]                # and (start of the last piece, its ids)
    before = ""
    for w in sorted(words):
        n, k = len(w), 0
        top = min(n, len(before))
        while k < top and w[k] == before[k]:
            k += 1
        del best[k + 1:], back[k + 1:]
        for j in range(k + 1, n + 1):
            score, link = -1e300, None
            for size in lengths(w[j - 3:j], ()) + (2, 1) if j >= 3 else range(j, 0, -1):
                i = j - size
                if i >= 0:
                    hit = get(w[i:j])
                    if hit is not None and best[i] + hit[0] > score:
                        score, link = best[i] + hit[0], (i, (hit[1],))
            if link is None or score < BYTE_SCORE / 2:
                raw = w[j - 1].encode()
                s = best[j - 1] + BYTE_SCORE * len(raw)
                if s > score:
                    score, link = s, (j - 1, tuple(v.byte_ids[b] for b in raw))
            best.append(score)
            back.append(link)
        ids, j = [], n
        while j:
            j, last = back[j]
            ids.append(last)
        out[w] = np.asarray([x for part in reversed(ids) for x in part], np.int32).tobytes()
        before = w
    return out


def encode_block(texts: list[str], v: Vocabulary, memo: dict[str, bytes]) -> list[bytes]:
    """int32 ids of each text. ``memo`` carries words over from earlier blocks."""
    parts = [CUT.findall(t) for t in texts]
    new = {w for p in parts for w in p}
    if len(memo) > MEMO_WORDS:
        memo.clear()
    memo.update(encode_words([w for w in new if w not in memo], v))
    return [b"".join(map(memo.__getitem__, p)) for p in parts]


def decode_ids(ids: np.ndarray, v: Vocabulary) -> str:
    return b"".join(map(v.pieces.__getitem__, ids.tolist())).decode("utf-8")


def decoder(path: str = MODEL_FILE):
    """Column function: array of ids -> text (null ids: empty text)."""

    @pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        v = load_vocabulary(path)
        return pd.Series([decode_ids(np.asarray(x, np.int32), v) if x is not None else "" for x in ids])

    return decode


def encode_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
                     path: str = MODEL_FILE) -> DataFrame:
    """doc_id, the columns of ``keep``, n_pieces, ids, ids_sha256 (little-endian int32) and
    round_trip (measured: the ids are decoded again and compared with the text): one row per
    row. A kept column with the name of one of these comes back as ``<name>_in``. Rows come back in small
    batches, so a task holds a block at a time."""
    own = {"doc_id", "n_pieces", "ids", "ids_sha256", "round_trip"}
    named = {k: f"{k}_in" if k.lower() in own else k for k in keep}
    text = next(n for n in (f"piece_text{i}" for i in range(len(keep) + 1)) if n not in {k.lower() for k in named.values()})
    rows = docs.select(F.col(id_col).alias("doc_id"), *[F.col(k).alias(n) for k, n in named.items()], F.coalesce(F.col(text_col), F.lit("")).alias(text))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_pieces", T.IntegerType()),
                           T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("ids_sha256", T.StringType()),
                           T.StructField("round_trip", T.BooleanType())])

    def run(batches):
        v, memo = load_vocabulary(path), {}
        for b in batches:
            sizes = pc.binary_length(b.column(b.num_columns - 1)).to_pylist()
            at = 0
            for part in chunks(sizes, lambda n: n, BLOCK_BYTES):
                block = b.slice(at, len(part))
                at += len(part)
                texts = block.column(b.num_columns - 1).to_pylist()
                raw = encode_block(texts, v, memo)
                flat = np.frombuffer(b"".join(raw), np.int32)
                n = np.asarray([len(x) // 4 for x in raw], np.int32)
                cut = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                same = [decode_ids(flat[cut[i]:cut[i + 1]], v) == t for i, t in enumerate(texts)]
                yield pa.RecordBatch.from_arrays(
                    [*block.columns[:-1], pa.array(n), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)),
                     pa.array([hashlib.sha256(x).hexdigest() for x in raw], pa.string()), pa.array(same, pa.bool_())],
                    names=schema.names)
        memo.clear()
        tidy()

    return rows.mapInArrow(run, schema)
