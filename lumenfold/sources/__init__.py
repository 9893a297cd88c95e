"""Readers and writers: binary codecs, capture corpora, carriers and GIF."""
