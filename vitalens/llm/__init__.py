"""Operators for training-data pipelines over documents, pages and embeddings.

Nothing else in the library imports this package.  Rules that hold throughout:
an operator reads only the columns it is told to, so extra columns and clashing
names do no harm; null and empty texts and empty tables have a defined result;
rows that agree in id and text are one document and get equal results.
"""
