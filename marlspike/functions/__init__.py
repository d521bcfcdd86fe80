"""Types, codecs and hashes."""
