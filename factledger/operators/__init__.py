"""Jobs over whole tables: state, identity, search, bulk matching, proofs."""
