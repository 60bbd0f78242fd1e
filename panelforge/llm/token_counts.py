"""Token counts of whole texts; very long texts are encoded in overlapping chunks that are spliced where they agree.

A text longer than `chunk` characters is cut into chunks that overlap by `overlap` characters. Two neighbours are joined
at a place inside the overlap that is proven stable: both have a word start there, `margin` characters away from where
either was cut, and the words on both sides of it, `agree` each, are the same tokens at the same offsets. Pre-tokenisers
scan from left to right with a look-ahead far below the margin, and words are encoded one by one, so from a common word
start on both chunks are what the whole text would give. If no such place exists (one endless word, say) the overlap is
doubled, and once it would reach back to the last splice the two chunks become one; in the end that is the whole text.

Texts up to `chunk` characters are encoded in small batches. Where the tokenizer file says that no token reaches over a
plain space (`parts_at_spaces`), the pieces that repeat in a batch are encoded once and their counts kept, and what is left
of a text is encoded as one; other files get the texts as they are. Memory: one batch and `KNOWN` pieces, or two chunks.

Defined cases: NULL and empty texts have 0 bytes and 0 tokens; repeated rows get a row each; an empty table gives an
empty result. Special strings inside texts count as the library counts them by default; no begin, end or other special
token is added; truncation and padding of the file are switched off. Other columns may have any name.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 32_768
OVERLAP = 1_024
MARGIN = 128
AGREE = 4
BATCH_CHARS = 1 << 18
KNOWN = 1 << 18
PIECE_CHARS = 64

#: Split patterns whose matches hold no white space and look at nothing around them.
SPACELESS = frozenset({r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"})

#: Tokens of a piece of text in order: id, start and end in the piece, and whether a word starts here.
Token = tuple[int, int, int, bool]
Encode = Callable[[str], list[Token]]


def load(path: str) -> Any:
    """The tokenizer behind a .json (tokenizers) or .model (sentencepiece) file."""
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counter(tokenizer: Any) -> Callable[[list[str]], list[int]]:
    if hasattr(tokenizer, "encode_batch_fast"):
        return lambda texts: [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    return lambda texts: [len(e) for e in tokenizer.encode(texts, num_threads=1)]


def parts_at_spaces(tokenizer: Any) -> bool:
    """Whether a text has the tokens of its parts between plain spaces: steps that work character by character (NFC joins
    nothing to a space), words without white space, each encoded alone, and special strings without one. Only steps known
    to be so count; any other file is encoded whole."""
    if not hasattr(tokenizer, "encode_batch_fast"):
        return False
    file = json.loads(tokenizer.to_str())

    def steps(name: str, inner: str) -> list[dict]:
        step = file.get(name)
        return [] if step is None else step[inner] if step["type"] == "Sequence" else [step]

    def plain(step: dict) -> bool:
        if step["type"] == "Replace":
            return step["pattern"] == {"Regex": r"\s+"} and step["content"] == " "
        return step["type"] in ("NFC", "Lowercase")

    words = steps("pre_tokenizer", "pretokenizers")
    return (
        all(plain(x) for x in steps("normalizer", "normalizers"))
        and [x["type"] for x in words] == ["Split", "ByteLevel"]
        and words[0]["pattern"].get("Regex") in SPACELESS
        and (words[0]["behavior"], words[0]["invert"]) == ("Removed", True)
        and not words[1]["add_prefix_space"]
        and not words[1]["use_regex"]
        and file["model"]["type"] == "BPE"
        and not file["model"]["dropout"]
        and not any(
            " " in a["content"] or a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in file["added_tokens"]
        )
    )


def piecewise(count: Callable[[list[str]], list[int]], known: int = KNOWN) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts from their parts between plain spaces. Parts that repeat in a batch are encoded once and
    remembered, at most `known` of them; the rest of a text is encoded as one."""
    counts: dict[str, int] = {}

    def counted(texts: list[str]) -> list[int]:
        parts = [t.split(" ") for t in texts]
        seen: Counter[str] = Counter()
        for p in parts:
            seen.update(p)
        new = [w for w, n in seen.items() if n > 1 and w not in counts and len(w) <= PIECE_CHARS]
        if len(counts) + len(new) > known:
            counts.clear()
            new = [w for w, n in seen.items() if n > 1 and len(w) <= PIECE_CHARS][:known]
        counts.update(zip(new, count(new)))
        rest = [" ".join([w for w in p if w not in counts]) for p in parts]
        return [n + sum([counts[w] for w in p if w in counts]) for n, p in zip(count(rest), parts)]

    return counted


def encoder(tokenizer: Any) -> Encode | None:
    """Tokens with offsets, or None where the library gives no words to splice at."""
    if not hasattr(tokenizer, "encode_batch_fast"):
        return None

    def encode(text: str) -> list[Token]:
        e = tokenizer.encode(text, add_special_tokens=False)
        out, last = [], object()
        for token, (start, end), word in zip(e.ids, e.offsets, e.word_ids):
            out.append((token, start, end, word != last))
            last = word
        return out

    return encode


def _moved(tokens: list[Token], by: int) -> list[Token]:
    return [(t, start + by, end + by, word) for t, start, end, word in tokens]


def _splice(left: list[Token], right: list[Token], low: int, high: int, agree: int) -> tuple[int, int] | None:
    """Indices of the token in both lists at the first stable place between low and high."""
    starts = {t[1]: j for j, t in enumerate(right) if t[3] and low <= t[1] <= high}
    words = [i for i, t in enumerate(left) if t[3]]
    for k in range(agree, len(words) - agree):
        i = words[k]
        j = starts.get(left[i][1])
        if j is None:
            continue
        before, after = i - words[k - agree], words[k + agree] - i
        if j >= before and left[i - before : i + after] == right[j - before : j + after]:
            return i, j
    return None


def count_long(
    text: str, encode: Encode, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN, agree: int = AGREE
) -> int:
    """Tokens of a text of any length."""
    begin, end, reach = 0, min(len(text), chunk + overlap), overlap
    left = encode(text[begin:end])
    first, total = 0, 0
    while end < len(text):
        start = end - reach
        if start <= begin:  # the overlap reaches back to the last splice: one larger chunk instead
            end = min(len(text), end + max(chunk, end - begin))
            at = left[first][1] if first < len(left) else begin
            left = _moved(encode(text[begin:end]), begin)
            first = next((i for i, t in enumerate(left) if t[3] and t[1] >= at), len(left)) if first else 0
            reach = overlap
            continue
        stop = min(len(text), start + chunk + reach)
        right = _moved(encode(text[start:stop]), start)
        found = _splice(left, right, start + margin, end - margin, agree)
        if found is None or found[0] < first:
            reach *= 2
            continue
        total += found[0] - first
        left, first, begin, end, reach = right, found[1], start, stop, overlap
    return total + len(left) - first


def _counts(texts: list[str], count: Callable[[list[str]], list[int]], encode: Encode | None, chunk: int, overlap: int) -> list[int]:
    out = [0] * len(texts)
    some: list[int] = []
    chars = 0

    def flush() -> None:
        for i, n in zip(some, count([texts[i] for i in some])):
            out[i] = n
        some.clear()

    for i, text in enumerate(texts):
        if encode is not None and len(text) > chunk + overlap:
            out[i] = count_long(text, encode, chunk, overlap)
            continue
        some.append(i)
        chars += len(text)
        if chars >= BATCH_CHARS:
            flush()
            chars = 0
    if some:
        flush()
    return out


def token_counts(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Bytes and tokens of every document under the tokenizer file at `path`, which every executor can read."""
    slim = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = f"`{id_col}` {slim.schema[0].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load(path)
        many, one = counter(tokenizer), encoder(tokenizer)
        if parts_at_spaces(tokenizer):
            many = piecewise(many)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = batch.column(1).to_pylist()
                n = _counts(texts, many, one, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(t.encode()) for t in texts], pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array([x > limit for x in n], pa.bool_()),
                    ],
                    [id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    return slim.mapInArrow(count, schema)
