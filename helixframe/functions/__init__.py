from helixframe.functions import dna, numbers

__all__ = ["dna", "numbers"]
