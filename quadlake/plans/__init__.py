"""From query text to DataFrames: parser, algebra, rewrites, compiler."""
