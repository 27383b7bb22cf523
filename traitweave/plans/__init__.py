"""Plan building blocks shared by the operators: joins, hashing, ordering."""
