"""Pictures of geometries: pixels, weights, filters, colours, tiles, PNG."""
