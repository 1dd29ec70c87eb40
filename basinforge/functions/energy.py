"""Scalar energies: Boltzmann weights, and the integer stacking model (hundredths of kcal/mol)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gas constant in cal/(mol K), zero of the Celsius scale, initiation of a duplex in hundredths of kcal/mol.
GAS, ZERO_C, DUPLEX_INIT = 1.98717, 273.15, 410

#: Published nearest-neighbour stacking energies at 37 degrees (hundredths of
#: kcal/mol), rows and columns in the order of STACK_ORDER; the column is the next pair read backwards.
STACK_ORDER = ("CG", "GC", "GU", "UG", "AU", "UA")
STACK = (
    (-240, -330, -210, -140, -210, -210),
    (-330, -340, -250, -150, -220, -240),
    (-210, -250, 130, -50, -140, -130),
    (-140, -150, -50, 30, -60, -100),
    (-210, -220, -140, -60, -110, -90),
    (-210, -240, -130, -100, -90, -130),
)


def stack_table() -> dict[str, int]:
    """By the letters of a pair and of the next one: "CGAU" is a stack of C-G and A-U."""
    return {p + q[1] + q[0]: STACK[r][c] for r, p in enumerate(STACK_ORDER) for c, q in enumerate(STACK_ORDER)}


def stack_energy(letters: Column) -> Column:
    """Energy of two stacked pairs from their four letters; null where one can't pair."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(stack_table().items())])
    return F.try_element_at(table, letters)


def thermal_energy(celsius: float = 37.0) -> float:
    """RT in kcal/mol."""
    return (celsius + ZERO_C) * GAS / 1000


def boltzmann(energy: Column, celsius: float = 37.0) -> Column:
    """exp(-E/RT), E in kcal/mol."""
    return F.exp(-energy / thermal_energy(celsius))


def free_energy(z: Column, celsius: float = 37.0) -> Column:
    """-RT ln Z; null for no weight."""
    return F.when(z > 0, -thermal_energy(celsius) * F.log(z))


def loop_energy(d1: Column, d2: Column) -> Column:
    """Interior loop between pairs that are d1 and d2 apart; nothing for adjacent pairs."""
    return F.when((d1 == 1) & (d2 == 1), F.lit(0)).otherwise(100 + 20 * (d1 + d2 - 2) + 50 * F.abs(d1 - d2))


def unpaired_energy(length1: Column, length2: Column) -> Column:
    """Cost of keeping both spans free of inner structure."""
    return 10 * (length1 + length2)
