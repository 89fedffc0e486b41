"""Column functions: codecs, bijections, text and dynamic values."""
