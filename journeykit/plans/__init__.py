from journeykit.plans.catalog import JourneyData, query_catalog

__all__ = ["JourneyData", "query_catalog"]
