"""Table readers, payload codecs, sinks and replay."""
