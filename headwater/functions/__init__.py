"""headwater.functions"""
