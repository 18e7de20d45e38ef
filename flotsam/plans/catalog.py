"""Imports every module of registered queries."""
from flotsam.plans import catalog_agg, catalog_dq, catalog_exp, catalog_join, catalog_ml, catalog_src, catalog_win  # noqa: F401
