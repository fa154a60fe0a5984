"""The pair codes of ``encode`` on arrays, for tasks that hold all pairs of a variant at once.

A missing value is -1 in; codes come out as cell numbers, with one more cell for missing.
"""

import numpy as np

from genopair.functions.encode import DOSAGE_LEVELS

DOSAGES = 3
# Genotypes of the alleles 0 to 3 are numbered below MORE_ALLELES; those with a later allele from there on.
FEW_ALLELES = 4
GENOTYPES = (FEW_ALLELES + 1) ** 2
MORE_ALLELES = 32


def dosage_cells(d: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Joint cell of both dosages: 4 d + r, 3 standing for a missing one. Every dosage code is a function of it."""
    side = lambda x: np.where((x < 0) | (x >= DOSAGES), DOSAGES, x).astype(np.int64)
    return side(d) * (DOSAGES + 1) + side(r)


def dosage_number(x: np.ndarray) -> np.ndarray:
    """A sample's dosage as a number below 4, so that a pair's joint cell is 4 d + r."""
    if x.dtype == np.int8:
        plain = x.view(np.uint8)  # a negative one is large as an unsigned one
        out = np.negative((plain >= DOSAGES).view(np.uint8))
        out |= plain
        out &= np.uint8(DOSAGES)
        return out
    return np.where((x < 0) | (x >= DOSAGES), DOSAGES, x).astype(np.uint8)


def code_of_cell(mode: str) -> list:
    """The code of each of the 16 joint cells, None where it is missing."""
    out = []
    for d in range(DOSAGES + 1):
        for r in range(DOSAGES + 1):
            if r == DOSAGES or (d == DOSAGES and mode != "recipient"):
                out.append(None)
            else:
                out.append({"count": abs(d - r), "count_directed": d - r, "pres_abs": int(d != r), "dr_genotype": 3 * d + r, "recipient": r}[mode])
    assert {c for c in out if c is not None} <= set(DOSAGE_LEVELS[mode])
    return out


def _known(*alleles: np.ndarray) -> np.ndarray:
    known = alleles[0] >= 0
    for a in alleles[1:]:
        known = known & (a >= 0)
    return known


def _shared(d1, d2, r1, r2) -> np.ndarray:
    first = ((d1 == r1) | (d1 == r2)).astype(np.int8)
    second = ((d2 == r1) | (d2 == r2)).astype(np.int8)
    return np.where(d1 == d2, first, first + second)


def allele_cells(mode: str, d1, d2, r1, r2) -> np.ndarray:
    """Mismatched alleles 0, 1, 2 (``count``) or 0, 1 (``presence``); the last cell is missing."""
    shared, homozygous = _shared(d1, d2, r1, r2), (d1 == d2) & (r1 == r2)
    n = np.where((shared == 2) | ((shared == 1) & homozygous), 0, np.where(shared == 1, 1, 2))
    if mode == "presence":
        return np.where(_known(d1, d2, r1, r2), n > 0, 2).astype(np.int64)
    return np.where(_known(d1, d2, r1, r2), n, 3).astype(np.int64)


def _change(donor, recipient) -> np.ndarray:
    return np.where(
        donor == 0, np.where(recipient == 1, 1, 2), np.where(donor == 1, np.where(recipient == 0, 3, 4), np.where(recipient == 0, 5, 6))
    )


def _unshared(a1, a2, b1, b2) -> np.ndarray:
    return np.where(a1 == a2, a1, np.where((a1 == b1) | (a1 == b2), a2, a1))


def mismatch_type_cells(d1, d2, r1, r2) -> tuple[np.ndarray, np.ndarray]:
    """Both slots' kinds of change, 0 to 6; cell 7 is missing."""
    shared, homozygous, known = _shared(d1, d2, r1, r2), (d1 == d2) & (r1 == r2), _known(d1, d2, r1, r2)
    slot1 = np.where(shared >= 1, 0, _change(d1, r1))
    one = _change(_unshared(d1, d2, r1, r2), _unshared(r1, r2, d1, d2))
    slot2 = np.where((shared == 2) | ((shared == 1) & homozygous), 0, np.where(shared == 1, one, _change(d2, r2)))
    return np.where(known, slot1, 7).astype(np.int64), np.where(known, slot2, 7).astype(np.int64)


def genotype_number(a1: np.ndarray, a2: np.ndarray) -> np.ndarray:
    """One number for both alleles of a sample, so that a pair looks up one value of either side."""
    known = (a1 >= 0) & (a2 >= 0)
    few = np.where(known, a1 * (FEW_ALLELES + 1) + a2, GENOTYPES - 1)
    return np.where(known & ((a1 >= FEW_ALLELES) | (a2 >= FEW_ALLELES)), MORE_ALLELES + a1 * 128 + a2, few).astype(np.int16)


def _of_number(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    more, few = g - MORE_ALLELES, np.where(g == GENOTYPES - 1, -1, 0)
    a1 = np.where(g >= MORE_ALLELES, more // 128, g // (FEW_ALLELES + 1))
    a2 = np.where(g >= MORE_ALLELES, more % 128, g % (FEW_ALLELES + 1))
    return np.where(few < 0, -1, a1), np.where(few < 0, -1, a2)


def by_genotypes(cells) -> "Callable[[np.ndarray, np.ndarray], np.ndarray]":  # noqa: F821
    """``cells(d1, d2, r1, r2)`` as a function of both genotype numbers: a look-up for few alleles, the codes themselves for more."""
    both = np.arange(GENOTYPES)
    d, r = np.repeat(both, GENOTYPES), np.tile(both, GENOTYPES)
    table = cells(*_of_number(d), *_of_number(r)).astype(np.int8)

    def of(d: np.ndarray, r: np.ndarray) -> np.ndarray:
        out = np.empty(d.shape, np.int8)
        more = (d.max(axis=1, initial=0) >= MORE_ALLELES) | (r.max(axis=1, initial=0) >= MORE_ALLELES)
        out[~more] = table[(d[~more] * np.int16(GENOTYPES) + r[~more])] if more.any() else table[d * np.int16(GENOTYPES) + r]
        if more.any():
            out[more] = cells(*_of_number(d[more]), *_of_number(r[more]))
        return out

    return of
