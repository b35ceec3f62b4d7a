"""Skip if the subpackage isn't there."""
