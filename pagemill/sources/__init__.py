"""Readers and writers: responses, HTML trees, sitemaps, manifests, documents."""
