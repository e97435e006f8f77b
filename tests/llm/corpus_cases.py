"""Small awkward tables for the corpus operators."""

from __future__ import annotations

import re
import zlib

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ("the river ran under a stone bridge while two old carts waited for rain and nobody in the village spoke about "
         "harvest prices or the long winter that had taken half of their sheep before spring came back again").split()


def prose(n: int, seed: int) -> str:
    """n words in short lines, without a random generator."""
    pick = [zlib.crc32(f"{seed}:{i}".encode()) for i in range(n)]
    out = [WORDS[x % len(WORDS)] + ("s" if x // 64 % 3 == 0 else "") for x in pick]
    return "\n".join(" ".join(out[i : i + 9]) + "." for i in range(0, n, 9))


def awkward() -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, repeated rows, copies under other ids."""
    rows = [(i, prose(60 + i, i), ("en", "de")[i % 2], f"s{i % 4}", 1) for i in range(24)]
    rows += [(100, None, "en", "s0", None), (101, "", "en", "s1", 0), (102, " \t\n ", None, None, 4), (103, prose(40000, 5), "de", "s0", 9), (None, prose(70, 77), "en", None, 2),
             (None, None, None, None, None), (104, "one", "en", "", 3), (105, prose(60, 0), "en", "s3", 5), (3, prose(63, 3), "de", "s3", 1), (3, prose(63, 3), "de", "s3", 1)]
    return rows


CLASHING = ("shard", "slot", "bucket", "text_hash", "fp", "node", "root", "n_lines", "n_removed", "draws", "target", "source_size", "block", "draw",
            "mix_key", "cut", "ks", "label", "score", "kept", "hash", "before", "size", "n_words", "page_id", "component_id", "first_id", "leaked_id")


def docs_of(spark, rows, clash: bool = True):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
    return df


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1
