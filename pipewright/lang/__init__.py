"""The filter language: parser, values and interpreter."""
