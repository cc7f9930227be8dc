"""Web-traffic and search analytics as Spark DataFrame operators.

Sub-packages:

``functions``  Column expressions and ranking helpers
``sources``    landed API responses and stored daily tables
``operators``  one module per family of DataFrame -> DataFrame operators
``plans``      the nightly ingest and the per-period report, put together
``sinks``      keyed upsert, scoped replace and the run log
``streaming``  incremental pick-up of newly landed responses
"""

from tidegauge.config import FloodRules, OpportunityRules, SignalRules, Site, SiteConfig

__all__ = ["FloodRules", "OpportunityRules", "SignalRules", "Site", "SiteConfig"]
