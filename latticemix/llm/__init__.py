"""Operators of a training-data pipeline; nothing else in the library imports them.

vector_dedup   near-duplicate vectors        token_files    token ids in binary files
line_dedup     lines shared by documents     quality_knn    quality by neighbours' votes
packing        windows of token ids          bpe_chunks     encoding by shared chunks
simhash        near-duplicate texts          quality_rules  rules in a cascade
html_text      main text of pages            ngram_lm       language-model scores

Column names that begin with two underscores are reserved for these operators.
"""
