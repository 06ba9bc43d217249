"""Cost predictions, placement what-ifs and the result contract, as queries."""
