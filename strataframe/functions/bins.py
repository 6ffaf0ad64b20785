"""Bins and classes of distances, frequencies and evidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Edges and labels of the bins.
TSS_EDGES = (3000, 12000, 35000)
TSS_LABELS = ("0-3kb", "3-12kb", "12-35kb", ">35kb")
MAF_EDGES = (0.05, 0.2)
MAF_LABELS = ("<0.05", "0.05-0.2", ">=0.2")
POSITIVE_PIP, LOW_PIP = 0.5, 0.01


def tss_bin(distance: Column, edges: tuple = TSS_EDGES, labels: tuple = TSS_LABELS) -> Column:
    """Right-closed bins of the absolute distance; null stays null."""
    d, out = F.abs(distance), None
    for edge, label in zip(edges, labels):
        out = F.when(d <= edge, label) if out is None else out.when(d <= edge, label)
    return F.when(d.isNotNull(), out.otherwise(labels[-1]))


def maf_bin(maf: Column, labels: tuple = MAF_LABELS) -> Column:
    """Left-closed bins up to 0.5, which is included; else null."""
    return F.when((maf >= 0) & (maf < MAF_EDGES[0]), labels[0]).when((maf >= MAF_EDGES[0]) & (maf < MAF_EDGES[1]), labels[1]).when((maf >= MAF_EDGES[1]) & (maf <= 0.5), labels[2])


def minor(af: Column) -> Column:
    """least() skips nulls, so a null frequency is kept null by hand."""
    return F.when(af.isNotNull(), F.least(af, 1 - af))


def pip_class(pip: Column, positive: float = POSITIVE_PIP, low: float = LOW_PIP) -> Column:
    return F.when(pip >= positive, "positive").when(pip < low, "low").otherwise("intermediate")


def in_pool(pip: Column, credible_set: Column) -> Column:
    """Positives always; low evidence only outside credible sets; intermediate only inside."""
    c = pip_class(pip)
    return F.when(c == "positive", True).when(c == "low", F.coalesce(credible_set, F.lit(0)) == 0).otherwise(F.coalesce(credible_set, F.lit(0)) > 0)


def log_distance(distance: Column) -> Column:
    return F.when(distance.isNotNull(), F.log10(F.greatest(F.abs(distance).cast("double"), F.lit(1.0))))
