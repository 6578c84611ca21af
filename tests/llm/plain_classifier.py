"""The quality classifier by its definition, in plain numbers; nothing of the module is used here."""

import math
import re
import zlib
from collections import Counter

BITS = 18
M = (1 << 64) - 1
# The settings of the query, and the multipliers that the features are hashed with.
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.5
ONE, TWO, AGAIN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


def look(word):
    out = re.sub(rb"[0-9]+", b"0", word)
    out = re.sub(rb"[A-Z]{2,}", b"AA", out)
    return re.sub(rb"[a-z\x80-\xff]+", b"a", out)


def features(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", text.encode()) if w]
    out = []
    for kind, hashes in enumerate(([zlib.crc32(w) for w in words], [zlib.crc32(look(w), 7) for w in words])):
        own = [(h + 1 + kind) * ONE & M for h in hashes]
        out += own + [(a ^ b >> 7) * TWO & M for a, b in zip(own, own[1:])]
    out += [((a == b) + 5) * AGAIN & M for a, b in zip(words, words[1:])]
    return [x >> 64 - BITS for x in out]


class Plain:
    """Follow-the-regularised-leader, a weight at a time; the bias is feature -1."""

    def __init__(self):
        self.z, self.n = Counter(), Counter()

    def weight(self, i):
        z = self.z[i]
        return 0.0 if abs(z) <= L1 else -(z - math.copysign(L1, z)) / ((BETA + math.sqrt(self.n[i])) / ALPHA + L2)

    def value(self, found):
        counts = Counter(found)
        return {i: k / math.sqrt(len(found)) for i, k in counts.items()} | {-1: 1.0}

    def score(self, text):
        dot = sum(self.weight(i) * x for i, x in self.value(features(text)).items())
        return 1 / (1 + math.exp(-max(-35.0, min(35.0, dot))))

    def learn(self, text, label):
        x = self.value(features(text))
        dot = sum(self.weight(i) * v for i, v in x.items())
        off = 1 / (1 + math.exp(-max(-35.0, min(35.0, dot)))) - label
        for i, v in x.items():
            g, w = off * v, self.weight(i)
            self.z[i] += g - (math.sqrt(self.n[i] + g * g) - math.sqrt(self.n[i])) / ALPHA * w
            self.n[i] += g * g


def trained(spark, texts, labels):
    """A model of the labelled texts by id that are not held out, in the order of the ids' hashes."""
    order = spark.createDataFrame([(i,) for i in texts], "i long").selectExpr("i", "xxhash64(cast(i as string)) as h").collect()
    model, seen = Plain(), set()
    for r in sorted(order, key=lambda r: r.h):
        if r.i in labels and zlib.crc32(str(r.i).encode()) % 5:
            model.learn(texts[r.i], labels[r.i])
            seen.add(labels[r.i])
    return model if len(seen) == 2 else None
