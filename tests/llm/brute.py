"""Plain re-computations on small tables, and fixtures that hold the awkward cases."""

import re
import zlib
from collections import Counter

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"

#: null and empty texts, white space of all kinds, repeated rows, special strings, a very long text
ODD_TEXTS = [None, "", "   ", "one", "one two", "One TWO three four", "a\x0bb  c", "x\x1c.y z", "tab\tq\r\n\n z  ",
             "<|endoftext|> x<|startoftext|>y", "日本 語,です。 ١٢٣ 12,345.67", "ª² ß ǅ ŉ, İstanbul ΑΣ Σ.", "it's don't, we'll. \"q\",",
             "same words here " * 40, "same words here " * 40, "line a b c\n" * 9 + "other", "###$$$ &&& |||", "long " * 30000,
             "é é a b", "\n\nlead", ".\n,\n"]


def odd_docs(spark):
    rows = [(i, t, "en", "s", 1, "x") for i, t in enumerate(ODD_TEXTS)] + [(3, "one", "en", "s", 1, "x"), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, label string")


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def crc_ids(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


def words(text):
    return re.findall("[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def simhash(text, n=3):
    w = words(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + n]) for i in range(max(1, len(w) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, bits=2):
    """Smallest id reachable for each (id, fingerprint)."""
    root = {f: f for _, f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    low = {}
    for d, f in fps:
        if d is not None:
            low[find(f)] = min(d, low.get(find(f), d))
    return {(d, f): low.get(find(f)) for d, f in fps}


def quality(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    n = dict(n_words=len(w), word_chars=sum(map(len, w)), n_symbols=len(re.findall(r"[#*$%&|<>]", t)),
             n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(inside))
    base = len(w) < 50 or 100 * len(inside) > 50 * len(w)
    bad = (base or 100 * n["n_symbols"] > 10 * len(w) or 2 * n["n_dup_lines"] > len(lines)
           or not 2 * len(w) <= n["word_chars"] <= 12 * len(w) or 100 * t.count("!") > 50 * len(w))
    return n | dict(base_failed=base, kept=not bad)
