"""Gradient-boosted trees and the analytics around them, as DataFrame plans."""
