"""Readers and parsers of specs, lookup tables, subtitles and logs; writers of frames."""
