"""Operators of a training-data pipeline: de-duplication, archives, personal data, secrets, quality,
language, source mixing, packing and vector search.  Nothing else in the library imports this
package; its queries are in `queries.py`."""
