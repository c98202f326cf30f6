"""Token counts: unigram segmentation, shared over a trie of distinct pre-tokens.

A pre-token is a word with the vocabulary's word mark before it. Its best segmentation
maximises the sum of its pieces' scores (fewest pieces among equals); a character that no
piece covers falls back to its UTF-8 bytes. The forward score of a prefix is the same in
every pre-token that begins with it. So the distinct pre-tokens that a task has not seen
yet are walked in the depth-first order of their trie (sorted order), scores are kept for
the current path only, and each shared prefix is scored once. Where a pre-token ends, its
count is stored; a document's count is the sum over its words.

Nothing is shuffled: a task reads texts in batches and keeps counts of up to ``KNOWN``
pre-tokens. The vocabulary (``path``, read by the driver) has a fixed size and is sent to
every task. Its pieces' scores are log probabilities by rank.

Defined cases: a null or blank text has no words and 0 tokens; a byte that is not UTF-8
counts as the replacement character; bytes between words are the
ASCII spaces; rows are counted one by one, whatever their ids; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.llm.common import table
from graphloft.shipping import ship

#: The vocabulary file, a parameter of the operator.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: the mark of a word's start in the vocabulary.
MARK = "▁"
#: Pre-tokens whose counts a task remembers.
KNOWN = 400_000
#: Added to the least score for each byte of an unknown character.
UNKNOWN = -10.0
#: Shift of the rank-frequency law (Mandelbrot's form of Zipf's) that gives pieces their probabilities.
SHIFT = 2.7


def pieces(path: str = VOCABULARY) -> dict[str, float]:
    """The vocabulary's ordinary pieces with their unigram scores: log probabilities that sum to 1.

    The file orders pieces but holds no probabilities, and a tokenizer is not trained here:
    the piece of rank r has a probability in proportion to ``1 / (r + SHIFT)``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = lambda i: not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    ranked = sorted((-model.get_score(i), model.id_to_piece(i)) for i in range(model.get_piece_size()) if usual(i))
    whole = math.log(sum(1 / (r + SHIFT) for r in range(1, len(ranked) + 1)))
    return {piece: -math.log(r + SHIFT) - whole for r, (_, piece) in enumerate(ranked, 1)}


def count(pre_tokens: list[str], vocabulary: dict[str, float]) -> dict[str, int]:
    """Tokens of each distinct pre-token, by one walk over their trie."""
    longest, least = max(map(len, vocabulary)), min(vocabulary.values()) + UNKNOWN
    get = vocabulary.get
    score, tokens = [0.0], [0]  # of the current path's prefixes
    before, out = "", {}
    for word in sorted(pre_tokens):
        shared, most = 0, min(len(before), len(word))
        while shared < most and before[shared] == word[shared]:
            shared += 1
        del score[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, n = score[end - 1] + least * size, tokens[end - 1] + size
            for start in range(max(0, end - longest), end):
                s = get(word[start:end])
                if s is not None:
                    s += score[start]
                    if s > best or s == best and tokens[start] + 1 < n:
                        best, n = s, tokens[start] + 1
            score.append(best)
            tokens.append(n)
        out[word] = tokens[-1]
        before = word
    return out


def token_counts(docs: DataFrame, vocabulary: dict[str, float]) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def work(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            ids, texts, n_words, n_tokens = b.column(0), b.column(1), [], []
            at = 0
            while at < b.num_rows:
                size, rows = 0, []
                while at < b.num_rows and (not rows or size < 1 << 21):  # some MB at a time
                    words = (texts[at].as_py() or b"").split()
                    rows.append(words)
                    size += sum(map(len, words)) if len(words) < 100 else 6 * len(words)
                    at += 1
                new = set().union(*rows)
                if len(known) + len(new) > KNOWN:
                    known = {}
                new -= known.keys()
                named = {w: MARK + w.decode("utf-8", "replace") for w in new}  # several may read alike
                counts = count(list(set(named.values())), sent.value)
                known.update((w, counts[x]) for w, x in named.items())
                n_words += map(len, rows)
                n_tokens += [sum(map(known.__getitem__, words)) for words in rows]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, "doc_id long, n_words long, n_tokens long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), pieces())
