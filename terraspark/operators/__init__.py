"""Table operators over pixels, maps, catalogs and vectors."""
