"""Readers and normalisers: raw pages, store records, reviews, posts, creatives."""
