"""Run settings used by the registered queries over the driver tables.

They play the part of the user's configuration (title terms, exclusions,
locations, blocked companies, run date). Operators take them as arguments.
"""

# Title terms picked so that the generated four-language text gives every
# branch of the filters real work: matches, misses and exclusions.
KEYWORDS = ["the", "tion", "ment", "ung", "ción"]
# "ein " keeps its trailing space on purpose (phrase-level exclusion).
EXCLUDES = ["sch", "eaux", "ein "]
# "delaware" exercises the state-abbreviation rule (", DE"), "fr" the short
# whole-word rule, "nation_7" the plain substring rule (it also hits NATION_17).
LOCATIONS = ["asia", "delaware", "fr", "nation_7", "united states"]
BLOCKED_COMPANIES = ["F.R. corp"]
RUN_DATE = "2024-02-01"
