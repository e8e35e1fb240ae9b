"""A PySpark-native engine for company-lead data: extraction, enrichment, scoring, quotas and listing."""
