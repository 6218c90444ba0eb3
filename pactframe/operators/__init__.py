"""Structure: keys, sequences, combinators, rules across fields and between versions of a row."""
