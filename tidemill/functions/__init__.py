"""Small building blocks shared by the operators."""
