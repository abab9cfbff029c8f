"""Matrix products and tile/row operators."""
