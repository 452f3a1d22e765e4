

from quarrylens.plans import catalog, catalog_families, catalog_flow, catalog_more, catalog_risk, catalog_scan, catalog_sources  # noqa: F401  (the others add to the first)
