"""Column functions: spectral indices, harmonic basis and solver, codecs."""
