"""Training-data operators (fingerprints, scans, classifiers, joins, audits).

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is present.
"""
