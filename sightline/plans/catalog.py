"""Imports every module that registers queries."""

from sightline.plans import address_queries, audit_queries, event_queries, fixture_queries, listing_queries, page_queries, payload_queries, profile_queries, prospect_queries, rank_queries, rule_queries, similarity_queries, sitemap_queries, star_queries, stream_queries, text_queries  # noqa: F401
