"""Imports every catalog module so that all queries are registered."""

from veritext.plans import (catalog, catalog_boosting, catalog_encode, catalog_lexicon, catalog_matrix,  # noqa: F401
                            catalog_metrics, catalog_models, catalog_runs, catalog_stream)
from veritext.plans.registry import ORACLES, QUERIES  # noqa: F401
