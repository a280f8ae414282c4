"""Made-up genomes, and a plain model of the comparison to hold the engine against."""

from __future__ import annotations

import math
import random
from collections import defaultdict

from strandloom.functions.mash import jaccard_to_distance, relaxed_minimum_shared, upper_identity

COMPLEMENT = str.maketrans("ACGTacgt", "TGCAtgca")
CODE = {"A": 0, "C": 1, "G": 2, "T": 3}


def random_dna(n: int, seed: int) -> str:
    return "".join(random.Random(seed).choices("ACGT", k=n))


def mutated(seq: str, rate: float, seed: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice([b for b in "ACGT" if b != c]) if rng.random() < rate else c for c in seq)


def reverse_complement(seq: str) -> str:
    return seq.translate(COMPLEMENT)[::-1]


def fasta(records: dict[str, str], width: int = 70) -> str:
    lines = []
    for name, seq in records.items():
        lines.append(f">{name} made up")
        lines += [seq[i : i + width] for i in range(0, len(seq), width)]
    return "\n".join(lines) + "\n"


def order(key: int, seed: int) -> int:
    x = (key + seed) % 2**32
    x ^= x >> 16
    x = x * 0x2C1B3C6D % 2**32
    x ^= x >> 15
    x = x * 0x297A2D39 % 2**32
    return x ^ (x >> 16)


def plain_minimizers(seq: str, k: int, w: int, seed: int) -> list[tuple[int, int]]:
    """(position, key), window by window."""
    seq = seq.upper()

    def code(s: str) -> int:
        value = 0
        for c in s:
            value = value * 4 + CODE[c]
        return value

    chosen: list[int] = []
    for i in range(len(seq) - (k + w - 1) + 1):
        window = seq[i : i + k + w - 1]
        if any(c not in CODE for c in window):
            continue
        ranked = []
        for j in range(i, i + w):
            kmer = seq[j : j + k]
            ranked.append((order(min(code(kmer), code(reverse_complement(kmer))), seed), j))
        least = min(r for r, _ in ranked)
        ties = [j for r, j in ranked if r == least]
        at = ties[0] if 2 * sum(c in "GT" for c in window) > len(window) else ties[-1]
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    found = []
    for j in chosen:
        a, b = code(seq[j : j + k]), code(reverse_complement(seq[j : j + k]))
        if a != b:
            found.append((j, min(a, b)))
    return found


def plain_fragments(n: int, length: int, stride: int, least: int) -> list[tuple[int, int]]:
    if n < least or n == 0:
        return []
    if stride == length == least:
        return [(i, i + length) for i in range(0, n - length + 1, length)]
    if n <= length:
        return [(0, n)]
    found, at = [], 0
    while at + length <= n:
        found.append((at, at + length))
        at += stride
    if n - at >= least:
        found.append((at, n))
    elif least == length and found[-1][1] != n:
        found.append((n - length, n))
    return found


def plain_score(query: list[int], reference: list[tuple[int, int]], start: int, end: int, length: int, k: int, w: int):
    wide = max(0, length - (w - 1) - (k - 1))
    best = None
    for p, _ in reference:
        if not start <= p <= end:
            continue
        window = {key for pos, key in reference if p <= pos < min(p + wide, end + length)}
        small = set(sorted(set(query) | window)[: len(query)])
        shared = len(small & set(query) & window)
        if shared and (best is None or shared > best[0]):
            best = [shared, p, p, len(window)]
        elif shared and shared == best[0]:
            best[2], best[3] = p, len(window)
    return best


def plain_mappings(queries: dict, references: dict, p) -> list[tuple]:
    """Mappings of {file: [contig, ...]} on {file: [contig, ...]} without N splitting: (query, file, contig, fragment,
    reference start, shared, sketch, identity)."""
    index, contigs, number = defaultdict(list), {}, 0
    for file, seqs in references.items():
        for seq in seqs:
            found = sorted(plain_minimizers(seq, p.kmer_size, p.window_size, p.hash_seed))
            contigs[number] = (file, found)
            for pos, key in found:
                index[key].append((number, pos))
            number += 1
    out = []
    for query, seqs in queries.items():
        fragment = 0
        for seq in seqs:
            for a, b in plain_fragments(len(seq), p.fragment_length, p.stride, p.least):
                sketch = sorted({key for _, key in plain_minimizers(seq[a:b], p.kmer_size, p.window_size, p.hash_seed)})
                if not sketch:
                    continue
                seeds = sketch[: p.minmer_count]
                m = max(1, relaxed_minimum_shared(len(seeds), p.kmer_size, p.mash_threshold, p.mash_confidence))
                hits = sorted(h for key in seeds for h in index[key])
                regions: list[list[int]] = []
                for (c, first), (d, last) in zip(hits, hits[m - 1 :]):
                    if c == d and last - first < b - a:
                        start = max(0, last - (b - a) + 1)
                        if regions and regions[-1][0] == c and regions[-1][2] >= start:
                            regions[-1][2] = max(regions[-1][2], first)
                        else:
                            regions.append([c, start, first])
                for c, start, end in regions:
                    file, reference = contigs[c]
                    best = plain_score(sketch, reference, start, end, b - a, p.kmer_size, p.window_size)
                    if best is None:
                        continue
                    if p.mash_threshold > 0 and upper_identity(len(sketch), best[0], p.kmer_size, p.mash_confidence) < p.mash_threshold:
                        continue
                    identity = 100 * (1 - jaccard_to_distance(best[0] / len(sketch), p.kmer_size))
                    out.append((query, file, c, fragment, (best[1] + best[2]) // 2, best[0], len(sketch), round(identity, 9)))
                fragment += 1
    return sorted(out)


def nan_equal(a: float, b: float) -> bool:
    return a == b or (math.isnan(a) and math.isnan(b))
