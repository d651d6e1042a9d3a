"""The catalogue of rules as a small dimension table: skill, stage, failure mode, title, effort, action."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Stages in report order and the importance of each, weights of severities, bands of confidence.
STAGES = ("DISCOVER", "IDENTIFY", "EXTRACT", "UNDERSTAND", "TRUST", "CITE", "ENGAGE")
STAGE_WEIGHT = {"DISCOVER": 1.0, "EXTRACT": 0.94, "IDENTIFY": 0.88, "TRUST": 0.82, "CITE": 0.76, "UNDERSTAND": 0.7, "ENGAGE": 0.64}
SEVERITY_WEIGHT = {"critical": 1.0, "high": 0.78, "medium": 0.46, "low": 0.22}
LEVEL_BAND = {"verified": (0.90, 0.99), "corroborated": (0.72, 0.89), "indicative": (0.40, 0.65)}
SKILLS = {"MR": "machine-readability", "FI": "fact-integrity", "AX": "arrival-experience", "EX": "external-evidence"}

#: rule | slug | stage | failure mode | effort | title | action; {example} and {count} are slots.
_ROWS = """
MR-001|important_paths_blocked_by_robots|DISCOVER|invisible|small|Content addresses are disallowed in robots.txt|Allow {example} in robots.txt
MR-002|noindex_on_content_page|DISCOVER|invisible|small|Content pages keep themselves out of indexes|Take the directive off {example}
MR-003|broken_internal_destinations|DISCOVER|invisible|small|Linked destinations of the site fail|Mend or redirect {count} destination(s)
MR-004|canonical_conflict|IDENTIFY|ambiguous|small|Canonical addresses contradict the pages|Point each canonical at the page's own lasting address
MR-005|client_side_rendering_gap|EXTRACT|invisible|large|Main content is not in the served document|Serve the content of {example} in the document
MR-006|navigation_outweighs_content|EXTRACT|misread|medium|Navigation outweighs content|Mark up the main content of {example}
MR-007|page_identity_metadata_missing|IDENTIFY|ambiguous|small|Pages can't be told apart by title or heading|Give every page a title and heading of its own
MR-008|no_usable_sitemap|DISCOVER|invisible|small|No usable sitemap, and links don't make up for it|Publish a sitemap and name it in robots.txt
MR-009|nondescriptive_link_labels|DISCOVER|invisible|medium|Links do not describe where they lead|Write labels that name the destination
FI-001|entity_name_inconsistency|IDENTIFY|ambiguous|small|The publisher is named inconsistently|Settle on one name everywhere
FI-002|no_entity_identity|IDENTIFY|ambiguous|medium|Nothing states who publishes the site|Add entity markup and a page about the publisher
FI-003|structured_data_contradicts_page|TRUST|misread|medium|Structured data contradicts the page|Make {field} of {example} agree with the page
FI-004|duplicate_content_unconsolidated|CITE|ambiguous|small|Copies of pages are not consolidated|Choose one address and point the canonical of the other at it
FI-005|timeliness_claimed_without_date_signal|TRUST|stale|small|Pages speak of now without a date|Publish the date of the last change
FI-006|currency_claimed_with_old_dates|TRUST|stale|small|Pages claim to be current with old dates|Renew the page or drop the claim
FI-007|editorial_without_attribution|CITE|ambiguous|small|Editorial pages name no author|Name author and publisher in markup
AX-001|title_body_mismatch|ENGAGE|bounce|small|The title promises what the page does not give|Let title, heading and text of {example} speak of one subject
AX-002|orientation_gap|UNDERSTAND|bounce|small|Pages never say plainly what they are about|Open {example} with one sentence that says what it is
AX-003|informational_dead_end|ENGAGE|bounce|small|Long pages offer no way on|Link to the next step from within the text
AX-004|unresolved_context_dependency|UNDERSTAND|invisible|medium|Content waits for a choice of place|Serve default content before the choice
AX-005|promotional_interference|EXTRACT|bounce|medium|Promotion crowds out substance|Cut repeated and promotional blocks
AX-006|interaction_gated_content|ENGAGE|bounce|medium|Substance is hidden until a visitor interacts|Show the substance of {example} at once
AX-007|buried_key_pages|ENGAGE|bounce|small|Key pages can't be reached from the entry page|Link key pages from the entry page
EX-001|declared_external_profile_unreachable|IDENTIFY|ambiguous|small|Declared outside references do not resolve|Mend or remove the references
EX-002|external_profile_does_not_corroborate_brand|IDENTIFY|ambiguous|medium|An outside reference never names the brand|Declare only references that name the brand
EX-003|ambiguous_name_without_disambiguation|IDENTIFY|ambiguous|medium|An everyday name with nothing to tell it apart|Publish identifiers in entity markup
EX-004|domain_name_mismatch_unbridged|IDENTIFY|ambiguous|small|Domain and name are unrelated and unconnected|State the address in entity markup
EX-005|hostname_variant_not_consolidated|IDENTIFY|ambiguous|small|The other form of the host serves a site of its own|Redirect the other form
EX-006|one_way_external_references|IDENTIFY|ambiguous|medium|Outside references never point back|Ask for a link back from records under control
"""
REGISTRY = [
    dict(zip(("rule", "slug", "stage", "failure_mode", "effort", "title", "action"), line.split("|"))) | {"skill": SKILLS[line[:2]]}
    for line in _ROWS.strip().split("\n")
]


def registry(spark: SparkSession) -> DataFrame:
    cols = ["rule", "slug", "skill", "stage", "failure_mode", "effort", "title", "action"]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in REGISTRY], ", ".join(f"{c} string" for c in cols))
