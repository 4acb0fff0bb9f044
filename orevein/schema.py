"""Fixed values of the ranking."""

#: Weight of a hit by section; any other section weighs 1.
SECTION_WEIGHTS = {"title": 2.0, "header": 1.5, "body": 1.0}
TFIDF_SHARE, PAGE_RANK_SHARE = 0.7, 0.3
