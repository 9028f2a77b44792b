"""Contacts of residues from their atoms: descriptors of a chain, neighbours in a sphere, chemistry and hydrogen bonds.

All of them come from equality joins over cells of a grid as wide as the cutoff; a structure has a bounded number of atoms,
and structures are shared out over tasks by structure and cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Residue classes, backbone atoms, and heavy atoms that give or take hydrogen bonds.
HYDROPHOBIC = ["ALA", "VAL", "ILE", "LEU", "MET", "PHE", "TYR", "TRP", "PRO"]
POLAR = ["SER", "THR", "ASN", "GLN", "CYS", "ASP", "GLU", "LYS", "ARG", "HIS"]
AROMATIC = ["PHE", "TYR", "TRP", "HIS"]
BACKBONE = ["N", "CA", "C", "O", "OXT"]
DONORS = {"ARG": ["NE", "NH1", "NH2"], "ASN": ["ND2"], "GLN": ["NE2"], "HIS": ["ND1", "NE2"], "LYS": ["NZ"], "SER": ["OG"], "THR": ["OG1"], "TRP": ["NE1"], "TYR": ["OH"]}
ACCEPTORS = {"ASP": ["OD1", "OD2"], "ASN": ["OD1"], "GLU": ["OE1", "OE2"], "GLN": ["OE1"], "HIS": ["ND1", "NE2"], "SER": ["OG"], "THR": ["OG1"]}

AXES = ["x", "y", "z"]


def _listed(residue: Column, atom: Column, table: dict[str, list[str]]) -> Column:
    known = F.create_map(*(c for r, names in table.items() for c in (F.lit(r), F.array(*map(F.lit, names)))))
    return F.coalesce(F.array_contains(F.coalesce(known[residue], F.array().cast("array<string>")), atom), F.lit(False))


def donor(residue: Column, atom: Column) -> Column:
    """The backbone's nitrogen but for proline's, and what is listed for the residue."""
    return ((atom == "N") & (residue != "PRO")) | _listed(residue, atom, DONORS)


def acceptor(residue: Column, atom: Column) -> Column:
    return atom.isin("O", "OXT") | _listed(residue, atom, ACCEPTORS)


def pairs_within(points: DataFrame, structure: str, radius: float, carried: list[str]) -> DataFrame:
    """Ordered pairs of a structure's points at most ``radius`` apart, both ways: structure, ``carried`` of the first and, with
    ``2`` behind the name, of the second, and ``distance``. A point with a null axis meets none."""
    cell = [F.floor(F.col(a) / radius).cast("long").alias(f"__{a}") for a in AXES]
    placed = points.select(structure, *AXES, *carried, *cell)
    around = placed
    for a in AXES:
        around = around.withColumn(f"__{a}", F.explode(F.array(*(F.col(f"__{a}") + d for d in (-1, 0, 1)))))
    cells = [f"__{a}" for a in AXES]
    other = placed.select(structure, *cells, *(F.col(c).alias(f"{c}2") for c in [*AXES, *carried]))
    square = sum(((F.col(a) - F.col(f"{a}2")) ** 2 for a in AXES), F.lit(0.0))
    near = around.join(other, [structure, *cells]).withColumn("distance", F.sqrt(square)).where(F.col("distance") <= radius)
    return near.select(structure, *carried, *(f"{c}2" for c in carried), "distance")


def apart(chain: str | None, position: str, least: int = 2) -> Column:
    """Residues of other chains, or more than ``least`` places away in their own."""
    far = F.abs(F.col(position) - F.col(f"{position}2")) > least
    return far | ~F.col(chain).eqNullSafe(F.col(f"{chain}2")) if chain else far


def chain_descriptors(points: DataFrame, structure: str, position: str, length: str | None = None, cutoff: float = 8.0, long_range: int = 24) -> DataFrame:
    """Compact geometry of each structure's chain from its points (one a residue, axes x, y, z).

    n, radius_normalized (gyration radius over the cube root of n), contact_count (pairs within ``cutoff`` and more than two places apart),
    contacts_per_residue, contact_density (of the pairs that may count), relative_contact_order (mean separation over ``length``, or n), long_range
    (share of contacts ``long_range`` or more apart), compactness (n over the gyration sphere's volume, 0 for one point) and asphericity.

    With eigenvalues l of the gyration tensor, asphericity is 1.5 sum (l - mean)**2 / (sum l)**2; both sums follow from the tensor's trace and the sum
    of its squared entries, so nothing is diagonalised. Structures of fewer than four points are left out.
    """
    keep = points.where(F.forall(F.array(*AXES), lambda v: v.isNotNull()) & F.col(position).isNotNull())
    tensor = {(a, b): F.covar_pop(a, b) for i, a in enumerate(AXES) for b in AXES[i:]}
    size = F.max(length) if length else F.count("*")
    stats = keep.groupBy(structure).agg(F.count("*").alias("n"), size.cast("double").alias("__length"), *(c.alias(f"t{a}{b}") for (a, b), c in tensor.items())).where("n >= 4")
    near = pairs_within(keep, structure, cutoff, [position]).where(F.col(position) < F.col(f"{position}2")).where(apart(None, position))
    separation = F.col(f"{position}2") - F.col(position)
    contacts = near.groupBy(structure).agg(F.count("*").alias("__k"), F.avg(separation).alias("__mean"), F.avg((separation >= long_range).cast("double")).alias("__long"))
    joined = stats.join(contacts, structure, "left").withColumn("__k", F.coalesce("__k", F.lit(0)))
    n, k = F.col("n").cast("double"), F.col("__k").cast("double")
    trace = sum((F.col(f"t{a}{a}") for a in AXES), F.lit(0.0))
    squares = sum((F.col(f"t{a}{b}") ** 2 * (1 if a == b else 2) for a, b in tensor), F.lit(0.0))
    radius = F.sqrt(trace)
    positive = F.when(trace > 0, trace)
    return joined.select(
        structure, "n", (radius / F.cbrt(n)).alias("radius_normalized"), F.col("__k").alias("contact_count"), (2 * k / n).alias("contacts_per_residue"), (k / F.greatest(n * (n - 1) / 2 - (2 * n - 3), F.lit(1.0))).alias("contact_density"),
        F.coalesce(F.col("__mean") / F.col("__length"), F.lit(0.0)).alias("relative_contact_order"), F.coalesce("__long", F.lit(0.0)).alias("long_range"),
        F.coalesce(n / (4.0 / 3 * F.pi() * F.sqrt(positive) ** 3), F.lit(0.0)).alias("compactness"), F.coalesce(1.5 * (squares - trace * trace / 3) / (positive * positive), F.lit(0.0)).alias("asphericity"),
    )


def residue_pairs(atoms: DataFrame, structure: str, position: str, chain: str | None = None, *, contact: float = 4.5, bond: float = 3.5) -> DataFrame:
    """Ordered pairs of residues in contact: structure, ``position``, residue, ``position``2, residue2, ``side`` (their side chains touch, too) and
    ``bonded`` (a donor of one is within ``bond`` of an acceptor of the other).

    ``atoms``: heavy atoms with ``residue``, ``atom`` and axes x, y, z. A contact is a least distance of at most ``contact``
    between atoms of residues that are not within two places in one chain.
    """
    residue, atom = F.upper("residue"), F.upper("atom")
    marked = atoms.select(structure, position, *([chain] if chain else []), residue.alias("residue"), *AXES, (~atom.isin(BACKBONE)).alias("side"), donor(residue, atom).alias("gives"), acceptor(residue, atom).alias("takes"))
    carried = [position, *([chain] if chain else []), "residue", "side", "gives", "takes"]
    near = pairs_within(marked, structure, max(contact, bond), carried).where(apart(chain, position))
    d = F.col("distance")
    link = (F.col("gives") & F.col("takes2")) | (F.col("takes") & F.col("gives2"))
    keys = [structure, *(f"{c}{s}" for s in ("", "2") for c in (position, *([chain] if chain else []), "residue"))]
    least = near.groupBy(*keys).agg(F.min(d).alias("distance"), F.min(F.when(F.col("side") & F.col("side2"), d)).alias("__side"), F.min(F.when(link, d)).alias("__bond"))
    return least.where(F.col("distance") <= contact).select(*keys, "distance", F.coalesce(F.col("__side") <= contact, F.lit(False)).alias("side"), F.coalesce(F.col("__bond") <= bond, F.lit(False)).alias("bonded"))


def contact_chemistry(pairs: DataFrame, centres: DataFrame, keys: list[str]) -> DataFrame:
    """For each residue of ``centres`` (``keys``): contacts, side-chain contacts, hydrogen-bonded partners, the counts of classes over side-chain
    contacts, and their shares (null without contacts).

    Polar with polar, hydrophobic with hydrophobic and the mixed pairs exclude one another; aromatic pairs and the partner's own class
    are counted beside them.
    """
    a, b = F.col("residue"), F.col("residue2")
    polar, oily, ring = ((a.isin(c), b.isin(c)) for c in (POLAR, HYDROPHOBIC, AROMATIC))
    classes = {
        "polar_polar": polar[0] & polar[1], "hydrophobic_hydrophobic": oily[0] & oily[1], "hydrophobic_polar": (oily[0] & polar[1]) | (polar[0] & oily[1]),
        "aromatic_aromatic": ring[0] & ring[1], "polar_partner": polar[1], "nonpolar_partner": oily[1],
    }
    number = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    sums = pairs.groupBy(*keys).agg(F.count("*").alias("contacts"), number(F.col("side")).alias("side_contacts"), number(F.col("bonded")).alias("bonded"), *(number(F.col("side") & c).alias(n) for n, c in classes.items()))
    counts = ["contacts", "side_contacts", "bonded", *classes]
    joined = centres.select(*keys).distinct().join(sums, keys, "left").select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    share = lambda c, of: (F.col(c) / F.when(F.col(of) > 0, F.col(of)))
    return joined.select(*keys, *counts, share("bonded", "contacts").alias("bonded_share"), *(share(c, "side_contacts").alias(f"{c}_share") for c in classes))


def sphere_neighbours(centres: DataFrame, pairs: DataFrame, structure: str, position: str, radius: float = 8.0) -> DataFrame:
    """For each residue: how many others lie in the sphere about its centre point, their composition as JSON with sorted names, and how many of
    them it touches. ``centres`` has structure, position, residue and axes; ``pairs`` comes from ``residue_pairs``."""
    near = pairs_within(centres, structure, radius, [position, "residue"]).where(apart(None, position))
    touching = pairs.select(structure, position, f"{position}2").withColumn("touch", F.lit(1))
    near = near.join(touching, [structure, position, f"{position}2"], "left")
    kinds = near.groupBy(structure, position, "residue2").agg(F.count("*").alias("n"), F.count("touch").alias("touch"))
    item = F.concat(F.lit('"'), F.col("residue2"), F.lit('": '), F.col("n").cast("string"))
    each = kinds.groupBy(structure, position).agg(F.sum("n").alias("neighbours"), F.sum("touch").alias("contact_density"), F.array_join(F.array_sort(F.collect_list(item)), ", ").alias("items"))
    out = centres.select(structure, position).join(each, [structure, position], "left")
    return out.select(structure, position, F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.concat(F.lit("{"), F.coalesce("items", F.lit("")), F.lit("}")).alias("composition"), F.coalesce("contact_density", F.lit(0)).alias("contact_density"))
