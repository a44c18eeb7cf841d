"""Schemas of the study's tables. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}


def schema(text: str) -> T.StructType:
    """From "name type, ..." with simple types and arrays of them; needs no session, unlike Spark's own parser."""

    def kind(name: str) -> T.DataType:
        return T.ArrayType(kind(name[6:-1])) if name.startswith("array<") else _TYPES[name]

    return T.StructType([T.StructField(n, kind(t)) for n, t in (x.split() for x in text.split(","))])


MANIFEST = schema("donor_id string, site string, disease_status string, perturbation_status string, inclusion_status string, exclusion_rationale string")
CELLS = schema("cell_id bigint, donor_id int, site int, cell_type string")
COUNTS = schema("cell_id bigint, gene_id string, n bigint")
NODES = schema("node bigint, x array<double>, y int, donor bigint, site string, part string")
EDGES = schema("src bigint, dst bigint, dist double")
SPLIT = schema("split_id string, seed int, train_donors array<int>, val_donors array<int>, test_donors array<int>")
RUN = schema("run_id string, model string, graph string, seed int, dataset string, dataset_version string, split_id string, split_hash string, feature_hash string, preprocessing_hash string, label_hash string, status string, macro_f1 double, balanced_accuracy double")
#: Keys on which two runs must agree to be compared.
MATCH_KEYS = ("dataset", "dataset_version", "split_id", "split_hash", "feature_hash", "preprocessing_hash", "label_hash")
PARTS = ("train", "val", "test")
